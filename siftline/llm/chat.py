"""Chat formatting in budgeted windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.llm.tables import stored

# The marks of the template.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"

# What could start a control string of this or a common template, or is the escape itself.
_CONTROL = r"\\|<(?=[|/s<\\])|\[(?=/?INST\]|\\)"
CHUNK = 256


def escaped(c: Column) -> Column:
    """A backslash after every character that could start a control string, and after every backslash."""
    return F.regexp_replace(c, _CONTROL, r"$0\\")


def unescaped(c: Column) -> Column:
    """The text before ``escaped``."""
    return F.regexp_replace(c, r"(?s)([\\<\[])\\", "$1")


def token_count(c: Column) -> Column:
    """Words plus marks: an estimate that needs no vocabulary."""
    return F.regexp_count(c, F.lit(r"\S+")) + 3


def chat_windows(
    turns: DataFrame, budget: int = 1024, history: int = 2, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", tokens=token_count,
) -> DataFrame:
    """Windows of at most ``budget`` tokens that begin and end at turns.

    Columns: ``conv_id``, ``chunk``, ``window``, ``formatted`` and ``turns``, an array with the role, ``fresh``
    (false for the system turn and the history repeated in front) and ``loss_from``, ``loss_chars``, the place of
    the text under the loss mask (assistant turns, once each; null otherwise).

    Prefix sums of the tokens of the turns choose the spans: a window takes turns while the sum since its first one
    stays within what the system turn and the history leave of the budget. A turn longer than that has a window of
    its own. Windows also break after every ``CHUNK`` numbers of ``turn``, and after every ``CHUNK`` rows where more
    rows than that share these numbers or have none, so a conversation of any length spreads over tasks and no task
    holds it whole.

    Null texts and roles are empty. Turns with equal or null numbers are ordered by role and text (null numbers
    first), repeated rows are kept, null ids form one conversation, an empty table gives no windows, and other
    columns are ignored. The system turn of a conversation is its first row if that has the role ``system``.
    """
    base = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("_turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    ).withColumn("chunk", F.coalesce(F.floor(F.col("_turn") / CHUNK), F.lit(-(2**62)).cast("bigint")))
    base = base.withColumn("_tokens", tokens(F.col("_text")).cast("bigint"))
    order = F.struct(
        F.col("_turn").isNotNull().alias("has"), F.col("_turn").alias("turn"),
        F.col("_role").alias("role"), F.col("_text").alias("text"),
    )
    row = F.struct(order.alias("at"), F.col("_tokens").alias("tokens"))

    # The first row of each conversation may be its system turn; an aggregate finds it and the first chunk without a sort.
    first = base.groupBy("conv_id").agg(F.min(F.struct("chunk", row.alias("row"))).alias("first")).select(
        F.col("conv_id").alias("_of"), F.col("first.chunk").alias("_first"),
        F.when(F.col("first.row.at.role") == "system", F.col("first.row")).alias("system"),
    )
    chunks = _numbered(base).groupBy("conv_id", "chunk", "_part").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    chunks = chunks.join(first, F.col("conv_id").eqNullSafe(F.col("_of")), "left").drop("_of")
    chunks = chunks.withColumn("opens", (F.col("chunk") == F.col("_first")) & (F.col("_part") == 0))

    # Prefix sums, then the places where windows begin: an array of (first, last) by one pass over the sums.
    sums = F.aggregate("rows", F.array(F.lit(0).cast("bigint")), lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + r.tokens)))
    chunks = chunks.withColumn("sums", sums)
    head = F.coalesce(F.col("system.tokens"), F.lit(0))
    back = lambda i: F.get("sums", i) - F.get("sums", F.greatest(i - history, F.lit(0)))
    starts = F.aggregate(
        F.sequence(F.lit(0), F.size("rows") - 1),
        F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("bigint").alias("room")),
        lambda a, i: F.when(
            (F.size(a.starts) == 0) | (F.get("sums", i + 1) - F.get("sums", F.element_at(a.starts, -1)) > a.room),
            F.struct(
                F.concat(a.starts, F.array(i)).alias("starts"),
                (F.lit(budget) - head - F.when((back(i) + head) * 2 <= budget, back(i)).otherwise(F.lit(0))).cast("bigint").alias("room"),
            ),
        ).otherwise(a),
    ).starts
    spans = chunks.withColumn("starts", starts).select("*", F.posexplode("starts").alias("window", "from"))
    spans = spans.withColumn("until", F.coalesce(F.get("starts", F.col("window") + 1), F.size("rows")))
    # History is repeated only where, with the system turn, it fills at most half of the budget.
    begin = F.when((back(F.col("from")) + head) * 2 <= budget, F.greatest(F.col("from") - history, F.lit(0))).otherwise(F.col("from"))
    opens_with_system = F.col("opens") & (begin == 0)
    old = F.slice("rows", begin + 1, F.col("from") - begin)
    new = F.slice("rows", F.col("from") + 1, F.col("until") - F.col("from"))
    as_turn = lambda fresh: lambda r: F.struct(
        r["at"]["role"].alias("role"), escaped(r["at"]["role"]).alias("who"), escaped(r["at"]["text"]).alias("said"),
        F.lit(fresh).alias("fresh"),
    )
    lead = F.when(F.col("system").isNotNull() & ~opens_with_system, F.transform(F.array("system"), as_turn(False)))
    parts = F.concat(
        F.coalesce(lead, F.transform(F.slice("rows", 1, 0), as_turn(False))), F.transform(old, as_turn(False)),
        F.transform(new, as_turn(True)),
    )
    spans = spans.withColumn("parts", parts)
    texts = F.transform("parts", lambda p: F.concat(F.lit(TURN), p.who, F.lit(SAYS), p.said, F.lit(END)))
    spans = spans.withColumn("texts", texts)
    ends = F.aggregate(
        "texts", F.array(F.lit(0).cast("bigint")), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t)))
    )
    spans = spans.withColumn("ends", ends)
    target = lambda p: p.fresh & (p.role == "assistant")
    marks = F.transform("parts", lambda p, i: F.struct(
        p.role.alias("role"), p.fresh.alias("fresh"),
        F.when(target(p), F.get("ends", i) + F.length(p.who) + len(TURN) + len(SAYS)).alias("loss_from"),
        F.when(target(p), F.length(p.said).cast("bigint")).alias("loss_chars"),
    ))
    return spans.select(
        "conv_id", "chunk", (F.col("_part") * CHUNK + F.col("window")).alias("window"),
        F.array_join("texts", "").alias("formatted"), marks.alias("turns"),
    )


def _numbered(base: DataFrame) -> DataFrame:
    """``base`` with ``_part``, which numbers runs of ``CHUNK`` rows in order within each chunk.

    Chunks of up to ``CHUNK`` rows are part 0. The rows of larger ones are ranked by a sort over all tasks and the
    counts of each task, so that no task meets a chunk whole. Equal rows are dealt at random, which no result shows.
    """
    counts = base.groupBy("conv_id", "chunk").count().filter(F.col("count") > CHUNK)
    large = counts.select(F.col("conv_id").alias("_of"), F.col("chunk").alias("_at"))
    if large.isEmpty():
        return base.withColumn("_part", F.lit(0).cast("bigint"))
    same = F.col("conv_id").eqNullSafe(F.col("_of")) & (F.col("chunk") == F.col("_at"))
    order = ["conv_id", "chunk", "_turn", "_role", "_text", "_tie"]
    ranked = base.join(large, same, "left_semi").withColumn("_tie", F.rand(7))
    ranked = ranked.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of a row within its task is what remains of its id; the file keeps both as they were.
    ranked = stored(ranked.select(
        *base.columns, F.spark_partition_id().alias("_task"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth"),
    ), "turns")
    tasks = ranked.groupBy("conv_id", "chunk", "_task").agg(F.min("_nth").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id", "chunk").orderBy("_task")) - F.col("n")
    tasks = tasks.select(
        F.col("conv_id").alias("_of"), F.col("chunk").alias("_at"), F.col("_task").alias("_in"),
        (before - F.col("low")).alias("shift"),
    )
    ranked = ranked.join(tasks, same & (F.col("_task") == F.col("_in")))
    ranked = ranked.withColumn("_part", F.floor((F.col("_nth") + F.col("shift")) / CHUNK)).select(*base.columns, "_part")
    few = base.join(large, same, "left_anti").withColumn("_part", F.lit(0).cast("bigint"))
    return few.unionByName(ranked)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per window with the ``turns`` (role, text) that are new in it and the unescaped ``loss`` text.

    Reads the formatted text alone; the array of turns tells which are repeated and where the loss mask lies.
    """
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), F.lit(2), F.size("turns"))
    told = F.filter(
        F.transform(F.arrays_zip(pieces.alias("piece"), F.col("turns").alias("mark")), lambda x: F.struct(
            x.mark.fresh.alias("fresh"),
            unescaped(F.split_part(x.piece, F.lit(SAYS), F.lit(1))).alias("role"),
            unescaped(F.split_part(F.split_part(x.piece, F.lit(SAYS), F.lit(2)), F.lit(END), F.lit(1))).alias("text"),
        )), lambda x: x.fresh,
    )
    loss = F.array_join(F.transform(
        F.filter("turns", lambda t: t.loss_from.isNotNull()),
        lambda t: unescaped(F.substring(F.col("formatted"), (t.loss_from + 1).cast("int"), t.loss_chars.cast("int"))),
    ), "")
    return windows.select("conv_id", "chunk", "window", told.alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars"))


def chat_digests(windows: DataFrame) -> DataFrame:
    """Counts and digests per conversation of what ``read_back`` finds."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    part = F.struct("chunk", "window", said.alias("said"), "loss", F.size("turns").alias("n"), "chars")
    whole = read_back(windows).groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    loss = F.array_join(F.transform("parts", lambda p: p.loss), "")
    total = lambda name: F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p[name])
    return whole.select(
        "conv_id", total("n").alias("n_turns"),
        F.sha2(F.array_join(F.transform("parts", lambda p: p.said), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )
