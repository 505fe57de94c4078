"""Quotation linking: conversations in reply order, without their quotes.

Lines that start with one or more `>` are quotes, nested as deep as they have marks.
Runs of lines of one level are passages. Normalised passages, and every line of them,
are hashed and joined to the normalised whole texts, paragraphs and lines that
messages of the same conversation say themselves. A message replies to the one that
it quotes at the first level; following these links gives threads. Column
expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.llm.common import in_range_order
from eventmill.session import stored

QUOTE = r"^[ \t]*(>[ \t]*)+"
#: Lines that only announce a quote, in the languages of the tables.
ANNOUNCE = r"^[ \t]*\S.*(wrote|writes|said|schrieb|schreibt|écrit|escribió)[ \t]*:[ \t]*$"
#: A line needs so many words to identify its message on its own.
LINE_WORDS = 3


def normalised(text: Column) -> Column:
    """Lower case, words of letters and digits, one blank between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed_lines(messages: DataFrame) -> DataFrame:
    """(msg_id, conv_id, turn, pos, level, line) of messages; level 0 is the message's own words."""
    line = F.col("line")
    marks = F.regexp_extract(line, QUOTE, 0)
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    rows = messages.select("msg_id", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.rtrim(line, F.lit("\r")))
    return rows.withColumn("level", level).withColumn("line", F.regexp_replace(line, QUOTE, ""))


def own_text(text: Column) -> Column:
    """A message without quoted lines and the lines that announce them."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    kept = F.filter(
        lines,
        lambda line, i: ~line.rlike(QUOTE)
        & ~(line.rlike(ANNOUNCE) & F.coalesce(F.get(lines, i + 1), F.lit("")).rlike(QUOTE)),
    )
    return F.when(F.coalesce(text, F.lit("")).rlike("(^|\n)[ \t]*>"), F.btrim(F.array_join(kept, "\n"), F.lit("\n\r\t "))).otherwise(
        F.coalesce(text, F.lit(""))
    )


def _passages(quoting: DataFrame) -> DataFrame:
    """(msg_id, conv_id, turn, level, passage, hash, whole): quoted runs, and their lines."""
    lines = parsed_lines(quoting)
    at = Window.partitionBy("msg_id").orderBy("pos")
    change = (F.col("level") != F.lag("level", 1, -1).over(at)).cast("int")
    runs = lines.withColumn("change", change).withColumn("run", F.sum("change").over(at))
    runs = runs.filter("level > 0")
    # One message's lines, which were one cell before.
    whole = runs.groupBy("msg_id", "conv_id", "turn", "level", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("passage")
    )
    parts = runs.select("msg_id", "conv_id", "turn", "level", "run", F.col("line").alias("passage"))
    both = whole.withColumn("whole", F.lit(True)).unionByName(parts.withColumn("whole", F.lit(False)))
    form = normalised(F.col("passage"))
    both = both.withColumn("form", form).filter(
        F.when(F.col("whole"), F.col("form") != "").otherwise(F.size(F.split("form", " ")) >= LINE_WORDS)
    )
    return both.withColumn("hash", F.md5("form")).drop("form")


def _sayings(messages: DataFrame) -> DataFrame:
    """(conv_id, hash, said_turn): the first message of the conversation that says it itself."""
    own = messages.select("conv_id", "turn", "own")
    pieces = F.concat(
        F.array("own"),
        F.split("own", r"\n[ \t\r]*\n"),
        F.split("own", "\n"),
    )
    said = own.select("conv_id", "turn", F.explode(F.array_distinct(pieces)).alias("piece"))
    said = said.select("conv_id", "turn", F.md5(normalised(F.col("piece"))).alias("hash"))
    return said.groupBy("conv_id", "hash").agg(F.min("turn").alias("said_turn"))


def links(messages: DataFrame) -> DataFrame:
    """(msg_id, level, passage, said_turn): quoted passages with the message they are from.

    A passage is found as a whole or else by the first message that says one of its lines.
    Passages that no earlier message of the conversation says have a null said_turn.
    """
    quoting = messages.filter(F.col("text").rlike("(^|\n)[ \t]*>"))
    quoted = stored(_passages(quoting))
    wanted = quoted.select("conv_id", "hash").distinct()
    said = _sayings(messages.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi"))
    found = quoted.join(said, ["conv_id", "hash"], "left").withColumn(
        "said_turn", F.when(F.col("said_turn") < F.col("turn"), F.col("said_turn"))
    )
    rows = found.groupBy("msg_id", "conv_id", "turn", "level", "run").agg(
        F.max(F.when(F.col("whole"), F.col("passage"))).alias("passage"),
        F.max(F.when(F.col("whole"), F.col("said_turn"))).alias("whole_turn"),
        F.min(F.when(~F.col("whole"), F.col("said_turn"))).alias("line_turn"),
    )
    return rows.withColumn("said_turn", F.coalesce("whole_turn", "line_turn")).drop("whole_turn", "line_turn")


def _sizes(parents: DataFrame) -> DataFrame:
    """`parents` with `size`: the turns at and below each turn that replies.

    In step k a turn counts those fewer than 2^k links below it; their counts go to the
    turn 2^k links above them. So a chain of n replies takes log n steps.
    """
    state = parents.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("size"))
    state = stored(state)
    while state.filter("up IS NOT NULL").limit(1).count():
        below = state.filter("up IS NOT NULL").groupBy("conv_id", F.col("up").alias("turn")).agg(F.sum("size").alias("more"))
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"))
        state = stored(
            state.join(below, ["conv_id", "turn"], "left")
            .join(above, ["conv_id", "up"], "left")
            .select("conv_id", "turn", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        )
    return parents.join(state.select("conv_id", "turn", "size"), ["conv_id", "turn"])


def _steps(sized: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, step): how far a reply comes after the turn it replies to.

    That is 1 and the sizes of its earlier siblings. The siblings are sorted in ranges, so
    the replies to one turn lie in many tasks: sums within a range, and those of the ranges
    before it.
    """
    family, order = ["conv_id", "reply_to"], ["conv_id", "reply_to", "turn"]
    seated = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    # Range bounds come from a sample: the outcome is stored, so that all sums see the same.
    seated = stored(seated.withColumn("part", F.shiftrightunsigned(F.monotonically_increasing_id(), 33)))
    ahead = Window.partitionBy(*family).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = seated.groupBy(*family, "part").agg(F.sum("size").alias("sum"))
    bases = sums.select(*family, "part", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy(*family, "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = seated.withColumn("earlier", earlier).join(bases, [*family, "part"])
    return placed.select("conv_id", "turn", "reply_to", (F.col("base") + F.col("earlier") + 1).alias("step"))


def conversations(messages: DataFrame) -> DataFrame:
    """Messages without quotes, in reply order.

    Per message: conv_id, turn, role, text (its own words), n_quotes (quoted
    passages), n_linked (those whose message is known), reply_to (the latest turn quoted at level 1), thread (the turn at which
    its chain of replies begins), depth (links to it) and place: gapless from 0 in the
    conversation, by thread; in a thread each message is followed by the replies to it, by
    turn, each with all that replies to it in its turn.

    A passage belongs to the first earlier turn that says it. Null texts are empty;
    messages with a null conv_id or turn are linked with nothing and come last in
    their conversation. Repeated rows stay as rows, and rows of one turn share a reply_to: the latest of any.
    Extra columns are ignored; an empty table gives no rows.
    """
    rows = messages.select(
        "conv_id",
        "turn",
        F.col("role").cast("string"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = stored(
        rows.withColumn("own", own_text(F.col("text"))).withColumn("msg_id", F.monotonically_increasing_id())
    )
    linked = stored(links(rows))
    counts = linked.groupBy("msg_id").agg(F.count("*").alias("n_quotes"), F.count("said_turn").alias("n_linked"))
    parents = linked.filter("level = 1 AND said_turn IS NOT NULL").groupBy("conv_id", "turn").agg(
        F.max("said_turn").alias("reply_to")
    )
    parents = stored(parents)
    # Only turns that reply to something move; a parent without a parent of its own is a root.
    # `path` adds up the steps on the way to the root: a reply's place after it.
    chain = _steps(_sizes(parents)).select(
        "conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).alias("depth"), F.col("step").alias("path")
    )
    chain = stored(chain)
    while True:
        above = chain.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("far"))
        moved = stored(
            chain.join(above, ["conv_id", "up"], "left").select(
                "conv_id",
                "turn",
                F.coalesce("next", "up").alias("up"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                (F.col("path") + F.coalesce("far", F.lit(0))).alias("path"),
                F.col("next").isNotNull().alias("moved"),
            )
        )
        chain = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            break
    threads = chain.select("conv_id", "turn", F.col("up").alias("thread"), "depth", "path")
    found = (
        rows.drop("text")
        .join(counts, "msg_id", "left")
        .join(parents, ["conv_id", "turn"], "left")
        .join(threads, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            F.col("own").alias("text"),
            F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            "reply_to",
            F.coalesce("thread", "turn").alias("thread"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
            F.coalesce("path", F.lit(0)).alias("path"),
            "msg_id",
        )
    )
    order = [F.col("thread").isNull(), F.col("thread"), F.col("path"), F.col("turn"), F.col("msg_id")]
    return in_range_order(found, ["conv_id"], order, "place").drop("msg_id", "path")
