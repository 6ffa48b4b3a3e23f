"""Reply-ordered conversations from quoted mail and forum text. DataFrame functions only.

A line that starts with ``>`` signs is quoted, as deep as it has signs. Lines
are normalised (lower case, single blanks) and hashed, and so are whole
passages: neighbouring lines of one level, parted by blank lines and lines of
another level, and all that a message has of its own, or quotes at one level
without another in between, whatever parts it. A hash leads to the latest earlier
message of the conversation whose own text holds that line or is that passage.
A message answers the message that most of its shallowest linked quotation
comes from (ties: the latest). Messages joined by answers form a thread, named
by its first turn; a conversation is ordered by thread, then turn, so that an
answer always follows what it answers. Quoted lines leave the text.

Messages without quotations cost one scan: only conversations with quotations
are cut into lines. The as-of search and the numbering work on stretches of
turns, so a very long conversation or a very common line fills several tasks.

Cases: null text is empty; a row with null conversation or turn has no links
(null turns are placed first, in 1,024 shares by a hash of role and text, each
in order of role and text); rows that repeat conversation and turn share their
links, each is kept, and counts as once; a quotation that no earlier message holds links
nothing; lines of blanks only part passages; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.common import materialize, workspace

#: Turns in one stretch.
STRETCH = 512
QUOTED = r"(?m)^[ \t]*>"
MARKS = r"^((?:[ \t]*>)+)"


def normalised(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def lines_of(messages: DataFrame) -> DataFrame:
    """(conv, turn, row, pos, level, norm) of every line; norm is empty for blank ones."""
    cut = messages.select("conv", "turn", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    cut = cut.withColumn("level", F.length(F.regexp_replace(marks, "[^>]", "")))
    return cut.withColumn("norm", normalised(F.expr(f"substring(line, length(regexp_extract(line, '{MARKS}', 1)) + 1)"))).drop("line")


def with_passages(lines: DataFrame) -> DataFrame:
    """The lines that aren't blank, and as one text each: the runs of two or more neighbouring lines
    of one level, and the runs that remain when blank lines and the other kind (own or quoted) are left out."""
    message = Window.partitionBy("conv", "turn", "row").orderBy("pos")
    kind = Window.partitionBy("conv", "turn", "row", "quoted").orderBy("pos")

    def numbered_runs(df: DataFrame, name: str, window, level: Column) -> DataFrame:
        new = (~F.lag(level).over(window).eqNullSafe(level)).cast("int")
        return df.withColumn("new", new).withColumn(name, F.sum("new").over(window)).drop("new")

    runs = numbered_runs(lines, "run", message, F.when(F.col("norm") != "", F.col("level"))).where("norm <> ''")
    runs = numbered_runs(runs.withColumn("quoted", F.col("level") > 0), "wide", kind, F.col("level"))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "norm")))["norm"], " ").alias("norm")
    keys = ["conv", "turn", "row", "level"]
    near = runs.groupBy(*keys, "run").agg(F.count("*").alias("n"), text).where("n > 1")
    wide = runs.groupBy(*keys, "wide").agg((F.min("run") < F.max("run")).alias("parted"), text).where("parted")
    out = ["conv", "turn", "level", "norm"]
    return runs.select(out).union(near.select(out)).union(wide.select(out))


def latest_before(asks: DataFrame, offers: DataFrame) -> DataFrame:
    """asks (conv, h, turn, level, size) with src: the largest offered turn of the same conv and h before the ask's, or dropped."""
    part = F.floor(F.col("turn") / STRETCH).alias("part")
    both = offers.select("conv", "h", "turn", part, F.lit(True).alias("offer"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("size")).distinct()
    both = both.unionByName(asks.select("conv", "h", "turn", part, F.lit(False).alias("offer"), "level", "size"))
    near = Window.partitionBy("conv", "h", "part").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("near", F.max(F.when(F.col("offer"), F.col("turn"))).over(near))
    parts = both.groupBy("conv", "h", "part").agg(F.max(F.when(F.col("offer"), F.col("turn"))).alias("top"))
    far = Window.partitionBy("conv", "h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("far", F.max("top").over(far)).select("conv", "h", "part", "far")
    found = both.where(~F.col("offer")).join(parts, ["conv", "h", "part"]).withColumn("src", F.coalesce("near", "far"))
    return found.where("src is not null").select("conv", "turn", "level", "size", "src")


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, n_linked): one row per message with a linked quotation."""
    known = messages.where("conv is not null and turn is not null")
    known = known.select("conv", "turn", "text")
    asking = known.where(F.col("text").rlike(QUOTED)).distinct()  # rows that repeat quote, and are quoted, once
    scope = known.join(asking.select("conv").distinct(), "conv", "left_semi").distinct()
    quotes = with_passages(lines_of(asking)).where("level > 0").select("conv", F.md5("norm").alias("h"), "turn", "level", F.length("norm").alias("size"))
    own = with_passages(lines_of(scope)).where("level = 0").select("conv", F.md5("norm").alias("h"), "turn")
    hits = latest_before(quotes, own)
    per = hits.groupBy("conv", "turn", "level", "src").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("level"), F.col("size"), F.col("src")))
    return per.groupBy("conv", "turn").agg(best.alias("b"), F.sum("n").alias("n_linked")).select("conv", "turn", F.col("b.src").alias("reply_to"), "n_linked")


def thread_roots(links: DataFrame, base: str) -> DataFrame:
    """(conv, turn, thread): the first message each answer leads back to, by pointer doubling."""
    cur = materialize(links.select("conv", "turn", F.col("reply_to").alias("thread")), f"{base}/0")
    for i in range(1, 64):
        up = cur.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        nxt = cur.join(up, ["conv", "thread"], "left").select("conv", "turn", F.coalesce("above", "thread").alias("thread"), F.col("above").isNotNull().alias("moved"))
        nxt = materialize(nxt, f"{base}/{i}")
        cur = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return cur
    raise RuntimeError("threads don't end")


def numbered(rows: DataFrame) -> DataFrame:
    """position: 1, 2, ... in each conv by (thread, turn, role, text); counts of stretches are added up, no window sees a whole conversation's rows."""
    share = F.pmod(F.xxhash64("role", "text"), F.lit(1024)) - 1024  # so that no window has all rows without a turn
    rows = rows.withColumns({"b1": F.floor(F.col("thread") / STRETCH), "b2": F.when(F.col("turn").isNull(), share).otherwise(F.floor(F.col("turn") / STRETCH))})
    fine = Window.partitionBy("conv", "thread", "b2").orderBy("turn", "role", "text")
    rows = rows.withColumn("r0", F.row_number().over(fine))

    def ahead(keys: list[str], by: str, counts: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn(name, F.coalesce(F.sum("n").over(w), F.lit(0)))

    c2 = ahead(["conv", "thread"], "b2", rows.groupBy("conv", "b1", "thread", "b2").agg(F.count("*").alias("n")), "r2")
    ct = ahead(["conv", "b1"], "thread", c2.groupBy("conv", "b1", "thread").agg(F.sum("n").alias("n")), "r1")
    c1 = ahead(["conv"], "b1", ct.groupBy("conv", "b1").agg(F.sum("n").alias("n")), "rb")
    off = c2.drop("n").alias("x").join(ct.drop("n").alias("y"), (F.col("x.conv").eqNullSafe(F.col("y.conv"))) & (F.col("x.thread").eqNullSafe(F.col("y.thread"))))
    off = off.select("x.conv", "x.b1", "x.thread", "x.b2", (F.col("r2") + F.col("r1")).alias("r"))
    off = off.alias("x").join(c1.drop("n").alias("y"), (F.col("x.conv").eqNullSafe(F.col("y.conv"))) & (F.col("x.b1").eqNullSafe(F.col("y.b1"))))
    off = off.select("x.conv", "x.thread", "x.b2", (F.col("r") + F.col("rb")).alias("r"))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in ("conv", "thread", "b2")]
    out = rows.alias("x").join(off.alias("y"), same[0] & same[1] & same[2])
    return out.select("x.*", (F.col("r0") + F.col("r")).cast("long").alias("position")).drop("b1", "b2", "r0")


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, position, turn, role, reply_to, thread, quote_depth, n_linked, text, formatted."""
    src = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = workspace(messages.sparkSession, "chat")
    links = materialize(reply_links(src), f"{base}/links")
    rows = src
    if links.isEmpty():
        rows = rows.withColumns({"reply_to": F.lit(None).cast("long"), "n_linked": F.lit(0).cast("long"), "thread": F.col("turn")})
    else:
        known = links.join(thread_roots(links, f"{base}/roots"), ["conv", "turn"])
        rows = src.join(known, ["conv", "turn"], "left").withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"), "thread": F.coalesce("thread", "turn")})
    depth = F.coalesce(F.array_max(F.transform(F.split("text", r"\r?\n"), lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")))), F.lit(0))
    own = F.trim(F.array_join(F.filter(F.split("text", r"\r?\n"), lambda x: ~x.rlike(MARKS)), "\n"))
    out = numbered(rows).withColumns({"quote_depth": depth.cast("int"), "own": F.when(F.col("text").rlike(QUOTED), own).otherwise(F.col("text"))})
    return out.select(
        F.col("conv").alias("conv_id"), "position", "turn", "role", "reply_to", "thread", "quote_depth", "n_linked", F.col("own").alias("text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own"), F.lit("\n<|end|>\n")).alias("formatted"),
    )
