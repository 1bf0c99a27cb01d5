"""Temperature mixing of sources, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Words as runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Cells of a source's permutation; sums per cell are scanned, never single documents over a whole source.
CELLS = 4096
_STEPS = 60


def source_weights(totals: DataFrame, entropy: float | None = 0.95, repeats: float | None = 4.0, budget: float | None = None) -> DataFrame:
    """Weights of sources from their totals (columns ``source`` and ``tokens``).

    A weight is proportional to ``share ** alpha``. The exponent is the largest
    in 0..1 at which the entropy of the weights is at least ``entropy`` times
    its maximum (the logarithm of the number of sources); then, if some source
    would be repeated more than ``repeats`` times within ``budget`` tokens
    (default: all tokens), the smallest exponent from there to 1 at which none
    is. Both are found by bisection inside one expression over the sources'
    totals; sources without tokens get weight 0. Returns ``source``, ``tokens``,
    ``alpha``, ``weight`` and ``quota`` (tokens of the budget), the last cut to
    ``repeats`` times the source where even exponent 1 repeats too much.
    """
    one = totals.where("tokens > 0").agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("t"))
    total = "aggregate(t, 0D, (a, x) -> a + x)"
    spend = f"{float(budget)}D" if budget is not None else total

    def norm(alpha: str) -> str:
        return f"aggregate(t, 0D, (a, x) -> a + pow(x / total, {alpha}))"

    def spread(alpha: str) -> str:
        """Entropy of the weights: log z - alpha * sum(p^alpha log p) / z."""
        return f"(ln({norm(alpha)}) - {alpha} * aggregate(t, 0D, (a, x) -> a + pow(x / total, {alpha}) * ln(x / total)) / {norm(alpha)})"

    def worst(alpha: str) -> str:
        """Most repeats: the smallest source's quota over its tokens."""
        return f"(pow(t[0] / total, {alpha}) / {norm(alpha)} * spend / t[0])"

    def bisect(low: str, high: str, right: str) -> str:
        """The point of low..high up to which ``right`` (in mid) holds."""
        return (f"aggregate(sequence(1, {_STEPS}), named_struct('lo', cast({low} as double), 'hi', cast({high} as double)), (s, i) -> "
                f"if({right}, named_struct('lo', (s.lo + s.hi) / 2, 'hi', s.hi), named_struct('lo', s.lo, 'hi', (s.lo + s.hi) / 2)), s -> s.lo)")

    mid = "((s.lo + s.hi) / 2)"
    one = one.where("size(t) > 0").selectExpr("t", f"{total} as total", f"{spend} as spend")
    if entropy is None:
        first = F.lit(1.0)
    else:
        goal = f"({float(entropy)}D * ln(cast(size(t) as double)) - 1e-12D)"
        first = F.expr(f"if({spread('1D')} >= {goal}, 1D, {bisect('0D', '1D', f'{spread(mid)} >= {goal}')})")
    one = one.withColumn("a0", first)
    if repeats is None:
        one = one.withColumn("alpha", F.col("a0"))
    else:
        limit = f"{float(repeats)}D"
        one = one.withColumn("alpha", F.expr(f"if({worst('a0')} <= {limit}, a0, {bisect('a0', '1D', f'{worst(mid)} > {limit}')})"))
    one = one.selectExpr("alpha", "total", "spend", f"{norm('alpha')} as z")
    cap = f"least(weight * spend, {float(repeats)}D * tokens)" if repeats is not None else "weight * spend"
    return (
        totals.crossJoin(F.broadcast(one))  # one row: the exponent
        .selectExpr("source", "tokens", "alpha", "spend", "if(tokens > 0, pow(tokens / total, alpha) / z, 0D) as weight")
        .selectExpr("source", "tokens", "alpha", "weight", f"cast(floor({cap} + 1e-6D) as bigint) as quota")
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, entropy: float | None = 0.95, repeats: float | None = 4.0, budget: float | None = None, seed: int = 1, blocks: int = 64,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cells: int = CELLS, carry: list[str] | None = None) -> DataFrame:
    """One row per chosen copy of a document: the id, the source, ``n_tokens``,
    ``epoch`` (0 for the first copy) and ``block``, with the input's columns
    ``carry`` as one struct column ``row``.

    A source's quota of tokens is spent on whole passes over the source and one
    partial pass over the head of its permutation (the order of a seeded hash of
    the id), never beyond the quota; a copy's position within the source's quota
    tells its block, so each of the ``blocks`` blocks mixes the sources by weight.

    Positions are sums per (source, cell of the hash), scanned over the cells,
    plus sums within a cell; so a source with a third of all rows is spread over
    ``cells`` window groups. Null sources are one source; null texts count as
    empty; documents without an id are placed by their text; documents without
    words take part only in whole passes; repeated rows are documents of their own,
    and where rows are carried those of one id and length go in the order of a hash of
    their texts, so that a task that runs again chooses the same.
    """
    number = F.coalesce(docs[id_col].cast("string"), F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), number).cast("binary"))
    skey = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit(""))  # never null, so that joins stay equi-joins
    rows = docs.select(
        docs[id_col].alias("id"), docs[source_col].alias("source"), skey.alias("skey"), word_count(docs[text_col].cast("string")).alias("n_tokens"), key.alias("h"),
        F.pmod(F.conv(F.substring(key, 1, 7), 16, 10).cast("long"), F.lit(cells)).cast("int").alias("cell"),
        *([F.struct(*(docs[c] for c in carry)).alias("row"), F.sha2(docs[text_col].cast("string").cast("binary"), 256).alias("tie")] if carry else []),
    )
    if not carry:
        rows = written(rows, "counted")  # words are counted once; with texts in tow, twice costs less than another copy of them
    sums = rows.groupBy(F.col("skey").alias("source"), "cell").agg(F.sum("n_tokens").alias("n"))
    totals = sums.groupBy("source").agg(F.sum("n").alias("tokens"))
    weights = source_weights(totals, entropy, repeats, budget)
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = sums.select("source", "cell", ahead.alias("ahead")).join(weights.select("source", "tokens", "quota"), "source")
    known = known.select(F.col("source").alias("skey"), "cell", "ahead", "tokens", "quota")
    within = F.sum("n_tokens").over(Window.partitionBy("skey", "cell").orderBy("h", "id", "n_tokens", *(["tie"] if carry else [])).rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("upto", within).join(known, ["skey", "cell"])
    row = ["row"] if carry else []
    placed = placed.selectExpr("id", "source", "n_tokens", *row, "ahead + upto as upto", "tokens", "quota")
    placed = placed.withColumn("passes", F.expr("if(tokens > 0, quota div tokens, 0)"))
    placed = placed.withColumn("copies", F.expr("cast(passes + if(n_tokens > 0 and upto <= quota - passes * tokens, 1, 0) as int)"))
    copies = placed.where("copies > 0").select("*", F.explode(F.expr("sequence(0, copies - 1)")).alias("epoch"))
    # the last token's position in the quota, from 1, cut into equal blocks
    block = F.expr(f"cast(greatest(0, (epoch * tokens + upto - 1) * {blocks} div quota) as int)")
    return copies.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "epoch", F.when(F.col("quota") > 0, block).otherwise(0).alias("block"), *row)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The input's rows as :func:`mix` chooses and repeats them, columns unchanged,
    dealt out by ranges of block: partition after partition (and file after file,
    once written) holds block after block, each in an order of its own that a hash
    of id and epoch gives. Rows of one block that repeat an id and epoch are side by side."""
    mixed = mix(docs, carry=docs.columns, **options)
    spot = F.xxhash64(F.col(options.get("id_col", "doc_id")), F.col("epoch"), F.lit(options.get("seed", 1)))
    return mixed.select("block", spot.alias("spot"), "row").repartitionByRange("block", "spot").sortWithinPartitions("block", "spot").select("row.*")
