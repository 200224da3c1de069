"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bit_sliced, lattice, minhash, mixing, ngram_bloom, quality, rtree, secret_scan, sentencepiece_chunks, spelling, substring, toxicity, url_filter
from .shared import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_bloom(spark, sf_dir):
    """Unigram and bigram scores of every document, learnt from those that aren't held out."""
    held_out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
    return ngram_bloom.score(table(spark, sf_dir, "documents"), held_out)


@query
def op3_lattice(spark, sf_dir):
    """Links, components and representatives of all vectors at a cosine of 0.9."""
    return lattice.linked_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_url_filter(spark, sf_dir):
    """Host, path, rule and verdict of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op5_setsketch(spark, sf_dir):
    """Near-duplicate groups of every document at a Jaccard similarity of 0.85 on five-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_toxicity_chain(spark, sf_dir):
    """Chained probabilities of low quality and toxicity for every document."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.classify(table(spark, sf_dir, "documents"), labels)


@query
def op7_sentencepiece(spark, sf_dir, model_path=None):
    """Ids and decoded text of every document under the 32k model, as digests."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepiece_chunks.encode(table(spark, sf_dir, "documents"), sentencepiece_chunks.read_model(model_path))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_doubling(spark, sf_dir):
    """Every document without the words of 20-word windows that start earlier elsewhere, as digests."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op10_bit_sliced(spark, sf_dir):
    """The 20 largest integer inner products of every vector whose id is divisible by 20."""
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


ORACLES["op10_bit_sliced"] = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
    where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20"""


@query
def op2_secret_scan(spark, sf_dir):
    """Secrets in every document: counts and digests of the fixed kinds, and all spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(secret_scan.named(base), 256).alias("base_sha256"),
                        secret_scan.named(F.concat(base, "entropy")).alias("spans"))


@query
def op9_source_mix(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# The schedule gives every source the blocks up to its target, so the words taken are an overlap of intervals.
ORACLES["op9_source_mix"] = """
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '')) as digest from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source is null, source) - 1) % 3) + 1] as weight, source_size * 2.0::double as cap from s),
l as (select *, row_number() over o as k, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0.0::double))
        / sum(weight) over (o rows between current row and unbounded following) as level from w window o as (order by cap / weight, source is null, source)),
f as (select arg_min(level, k) as level from l where cap > level * weight),
t as (select source, source_size, least(cap, coalesce(f.level * weight, cap)) as target from l left join f on true),
p as (select d.*, coalesce(cast(sum(size) over (partition by source order by digest, doc_id, size rows between unbounded preceding and 1 preceding) as bigint), 0) as start from d),
j as (select p.doc_id, p.size, t.source_size, t.target, p.start, cast(floor(t.target + 0.5) as bigint) as take from p join t on p.source is not distinct from t.source)
select doc_id, size, source_size, target,
    greatest(0, least(size, take - start)) + greatest(0, least(size, take - source_size - start)) as taken from j"""


@query
def op11_trie_pairs(spark, sf_dir):
    """Forms and roots of all words of at least 7 code points that occur twice or more, one code point of every 31st run deleted."""
    return spelling.group_variants(spelling.counted(table(spark, sf_dir, "documents"), every=31))


@query
def op12_random_index(spark, sf_dir):
    """Probability of good quality of every document, learnt from the labels of those that aren't held out."""
    held_out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


@query
def op13_rtree(spark, sf_dir):
    """Hard negatives of every vector whose id is divisible by 100; every seventh vector has another label."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLES["op13_rtree"] = """
with v as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
    where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.id as anchor_id, c.id, a.label = c.label as same, cast(list_inner_product(cast(a.e as double[]), cast(c.e as double[])) as bigint) as score
    from v a join v c on a.id <> c.id and len(a.e) = len(c.e) where a.id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.*, s.id as negative_id, s.score as negative_score, cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as integer) as rank
    from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10"""
