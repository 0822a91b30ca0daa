"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.llm.shared import materialise

#: Words of a block, shards of a source at most, and words that a shard has at least on average.
BLOCK_WORDS, SHARDS, SHARD_WORDS = 64, 256, 4096  # SHARDS: a power of two
#: A document is taken so often at most.
REPEATS = 3
SEED = 42


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """sources: source, source_size. Adds weight, target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the sum of all sizes by weight; none is
    above repeats times its source's size, and what is cut off goes to the others by weight until none is above. In the
    order of limit over weight, the capped sources come first: one is capped if its limit is below its share of what the
    ones before it leave."""
    one = F.lit(1)
    w = sources.withColumn("weight", ((F.row_number().over(W.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    w = w.withColumn("limit_words", F.col("source_size") * repeats)
    order = W.partitionBy(one).orderBy((F.col("limit_words") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(one)
    w = w.withColumn("left_words", F.sum("source_size").over(whole) - F.coalesce(F.sum("limit_words").over(before), F.lit(0)))
    w = w.withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("capped", F.col("limit_words") * F.col("left_weight") <= F.col("left_words") * F.col("weight"))
    # of the first source that is not capped on, all share alike
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("limit_words") / F.col("weight"), F.col("left_words"), F.col("left_weight")))).over(whole)
    share = F.col("weight") * free.getField("left_words").cast("double") / free.getField("left_weight").cast("double")
    return w.withColumn("target", F.when(F.col("capped"), F.col("limit_words").cast("double")).otherwise(share)).select("source", "source_size", "weight", "target")


def sainte_lague(claims: DataFrame, by: list[str], share: str, seats: str, order: list[Column]) -> DataFrame:
    """Adds quota: `seats` integer units (one number for each group of by) go one by one to the claim with the highest
    quotient share / (2k + 1), k being the units it has; ties go by order.

    With n claims and N seats the final divisor differs from sum / N by a factor of 1 +- n / 2N at most, so a claim surely
    gets the units below that range; only the quotients inside it, about four a claim, are listed and ranked."""
    group = W.partitionBy(*by)
    columns = claims.columns
    c = claims.withColumn("_sum", F.sum(share).over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    ideal = F.when(F.col("_sum") > 0, F.col(share) * F.col(seats) / F.col("_sum")).otherwise(F.lit(0.0))
    slack = ideal * F.col("_n") / (2 * F.greatest(F.col(seats), F.lit(1)))
    c = c.withColumn("_low", F.greatest(F.floor(ideal - slack) - 1, F.lit(0)).cast("long"))
    c = c.withColumn("_high", (F.ceil(ideal + slack) + 1).cast("long"))
    c = c.withColumn("_rest", F.col(seats) - F.sum("_low").over(group))
    listed = c.withColumn("_k", F.explode(F.sequence("_low", "_high")))
    rank = F.row_number().over(group.orderBy((F.col(share) / (2 * F.col("_k") + 1)).desc(), *order, F.col("_k")))
    won = ((rank <= F.col("_rest")) & (F.col(share) > 0)).cast("long")
    return listed.withColumn("_won", won).groupBy(*columns).agg((F.max("_low") + F.sum("_won")).alias("quota"))


def plan_mix(rows: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, shard_words: int = SHARD_WORDS, repeats: int = REPEATS) -> DataFrame:
    """rows: source, bucket (0 to shards - 1), size. One row for each source and bucket: source_size, target, shard,
    shard_size, quota (blocks of the shard). Everything after the first sum is on sources x shards rows at most."""
    cells = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-cells")
    plan = targets(cells.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), repeats).withColumn("_all", F.lit(1))
    plan = plan.withColumn("seats", F.round(F.sum("source_size").over(W.partitionBy("_all")) / block_words).cast("long"))
    plan = sainte_lague(plan, ["_all"], "target", "seats", [F.col("source").asc_nulls_last()])
    steps = F.floor(F.log2(F.greatest(F.col("source_size") / shard_words, F.lit(1.0))))
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", F.col("quota").alias("source_quota"), F.least(F.pow(F.lit(2.0), steps), F.lit(shards)).cast("long").alias("n_shards"))
    placed = cells.join(plan, cells["source"].eqNullSafe(plan["_source"])).drop("_source").withColumn("shard", F.col("bucket") % F.col("n_shards"))
    sized = placed.groupBy("source", "shard", "source_quota").agg(F.sum("bucket_size").alias("shard_size"))
    quotas = sainte_lague(sized, ["source"], "shard_size", "source_quota", [F.col("shard")])
    quotas = quotas.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "quota")
    out = placed.join(quotas, placed["source"].eqNullSafe(quotas["_source"]) & (placed["shard"] == quotas["_shard"]))
    return materialise(out.select("source", "bucket", "source_size", "target", "shard", "shard_size", "quota"), "mix-plan")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[Column, ...] = (), block_words: int = BLOCK_WORDS, shards: int = SHARDS, shard_words: int = SHARD_WORDS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, shard, first_word (where it begins in its shard), taken, and keep.

    A source's documents are dealt by a seeded digest of id and text into its shards and laid out there in the digest's
    order; the words of that row are cut into equal blocks. Sainte-Laguë apportions the blocks of all targets to the
    sources, and a source's blocks to its shards by their sizes; a shard's quota selects that many blocks from the start
    of its row, going round it up to `repeats` times. taken is the words of a document in the selected blocks, repeats
    counted. Shards of one source are handled apart, so a large source is as spread as many small ones; the plan is
    broadcast only if its table is below Spark's own limit for that.

    Null texts have size 0; a null source is a source, the last by order; a null id counts as the empty text in the
    digest; rows alike in id and text lie side by side; an empty table gives no rows; other columns are ignored."""
    text = docs[text_col].cast("string")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs[id_col].cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(text).alias("size"), digest.alias("_digest"), *keep)
    rows = rows.withColumn("_bucket", F.conv(F.substring("_digest", 1, 6), 16, 10).cast("long") % shards)
    plan = plan_mix(rows.select("source", F.col("_bucket").alias("bucket"), "size"), block_words, shards, shard_words, repeats)
    plan = plan.withColumnRenamed("source", "_source").withColumnRenamed("bucket", "_cell")
    dealt = rows.join(plan, rows["source"].eqNullSafe(plan["_source"]) & (rows["_bucket"] == plan["_cell"]))
    row = W.partitionBy("source", "shard").orderBy("_digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    dealt = dealt.withColumn("first_word", F.coalesce(F.sum("size").over(row), F.lit(0)))
    chosen = F.least(F.col("quota") * block_words, F.col("shard_size") * repeats)
    whole = F.when(F.col("shard_size") > 0, F.floor(chosen / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    part = F.greatest(F.least(F.col("first_word") + F.col("size"), chosen - whole * F.col("shard_size")) - F.col("first_word"), F.lit(0))
    dealt = dealt.withColumn("taken", (whole * F.col("size") + part).cast("long"))
    kept = dealt.columns[4 : 4 + len(keep)]
    return dealt.select("doc_id", "source", "size", "source_size", "target", "shard", "first_word", "taken", *kept)


def mix_sql(block_words: int = BLOCK_WORDS, shards: int = SHARDS, shard_words: int = SHARD_WORDS, repeats: int = REPEATS, seed: int = SEED) -> str:
    """The same in DuckDB's SQL: doc_id, size, source_size, target, taken of documents. Sainte-Laguë lists every quotient
    near the limit as sainte_lague() does."""

    def seats(name: str, claims: str, by: str, keys: str, share: str, seats: str, order: str) -> str:
        return f"""
{name}_c AS (SELECT *, sum({share}) OVER w AS s_, count(*) OVER w AS n_ FROM {claims} WINDOW w AS (PARTITION BY {by})),
{name}_i AS (SELECT *, CASE WHEN s_ > 0 THEN {share} * {seats} / s_ ELSE 0.0 END AS ideal FROM {name}_c),
{name}_r AS (SELECT *, CAST(greatest(floor(ideal - ideal * n_ / (2 * greatest({seats}, 1))) - 1, 0) AS BIGINT) AS low,
             CAST(ceil(ideal + ideal * n_ / (2 * greatest({seats}, 1))) + 1 AS BIGINT) AS high FROM {name}_i),
{name}_k AS (SELECT *, {seats} - sum(low) OVER (PARTITION BY {by}) AS rest FROM {name}_r),
{name}_l AS (SELECT *, unnest(range(low, high + 1)) AS k FROM {name}_k),
{name}_w AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {share} / (2 * k + 1) DESC, {order}, k) AS rank_ FROM {name}_l),
{name} AS (SELECT {keys}, max(low) + sum(CASE WHEN rank_ <= rest AND {share} > 0 THEN 1 ELSE 0 END) AS quota FROM {name}_w GROUP BY {keys})"""

    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(concat_ws(':', '{seed}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS digest FROM documents),
r AS (SELECT *, CAST(('0x' || substr(digest, 1, 6)) AS BIGINT) % {shards} AS bucket FROM d),
cells AS (SELECT source, bucket, CAST(sum(size) AS BIGINT) AS bucket_size FROM r GROUP BY ALL),
s0 AS (SELECT source, CAST(sum(bucket_size) AS BIGINT) AS source_size FROM cells GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * {repeats} AS lim FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER o, 0) AS left_words, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight
       FROM s1 WINDOW o AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, lim * left_weight <= left_words * weight AS capped, lim / weight AS ratio FROM s2),
f AS (SELECT left_words AS fw, left_weight AS fg FROM s3 WHERE NOT capped ORDER BY ratio, left_words, left_weight LIMIT 1),
src AS (SELECT source, source_size, 1 AS everything, CAST(round(sum(source_size) OVER () / {block_words}) AS BIGINT) AS seats,
        CASE WHEN capped THEN CAST(lim AS DOUBLE) ELSE weight * CAST(fw AS DOUBLE) / CAST(fg AS DOUBLE) END AS target FROM s3 LEFT JOIN f ON true),
{seats("q", "src", "everything", "source, source_size, target", "target", "seats", "source NULLS LAST").strip()},
p AS (SELECT c.*, q.source_size, q.target, CAST(q.quota AS BIGINT) AS source_quota,
      c.bucket % CAST(least(pow(2, floor(log2(greatest(q.source_size / {shard_words}, 1.0)))), {shards}) AS BIGINT) AS shard
      FROM cells c JOIN q ON c.source IS NOT DISTINCT FROM q.source),
z AS (SELECT source, shard, source_quota, CAST(sum(bucket_size) AS BIGINT) AS shard_size FROM p GROUP BY ALL),
{seats("h", "z", "source", "source, shard, shard_size", "shard_size", "source_quota", "shard").strip()},
t AS (SELECT r.doc_id, r.size, p.source_size, p.target, h.shard_size, least(CAST(h.quota AS BIGINT) * {block_words}, h.shard_size * {repeats}) AS chosen,
      CAST(coalesce(sum(r.size) OVER (PARTITION BY r.source, p.shard ORDER BY r.digest, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_word
      FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.bucket = p.bucket
      JOIN h ON p.source IS NOT DISTINCT FROM h.source AND p.shard = h.shard),
u AS (SELECT *, CASE WHEN shard_size > 0 THEN chosen // shard_size ELSE 0 END AS whole FROM t)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(least(first_word + size, chosen - whole * shard_size) - first_word, 0) AS BIGINT) AS taken FROM u"""
