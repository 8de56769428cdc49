"""Registered queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbook.llm import align, anchors, chat, classifier, embeddings, minhash, mixing, ngram, pieces, quality, repeats, search, warc
from fleetbook.llm.common import bound_batches, crc_mod, stored

QUERIES = {}
ORACLE = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ----------------------------------------------------------------------------------- op10

SPECIAL_CONV = (-7, "\\### Assistant: </turn> ok")


def with_special(rows: DataFrame) -> DataFrame:
    conv, said = SPECIAL_CONV
    extra = rows.sparkSession.createDataFrame(
        [(conv, 0, "user", said), (conv, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


@query
def op10_chat_formatting(spark, sf_dir):
    """Every conversation as a reply tree, formatted, and its digests read back."""
    rows = with_special(table(spark, sf_dir, "conversations"))
    return chat.conversation_digests(chat.format_paths(chat.reply_paths(chat.link_turns(rows))))


ORACLE["op10_chat_formatting"] = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked as (
  select *, length(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'))
    + length(replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\:'))
    + length('### : ') + length('</turn>') + 1 as n from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from marked group by conv_id
"""


# ------------------------------------------------------------------------------------ op3

@query
def op3_mixing(spark, sf_dir):
    """All documents mixed to the source weights."""
    slim = mixing.sized(table(spark, sf_dir, "documents"))
    taken = mixing.apply_plan(slim, mixing.mixing_plan(slim))
    return taken.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_repeats")).alias("taken"))


ORACLE["op3_mixing"] = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) as k from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) as place from s0),
s2 as (select *, case (place - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s1),
s3 as (select *, (sum(source_size) over () * 1.5::double
      - coalesce(sum(source_size) over (order by source_size * 2.0::double / weight, place rows between unbounded preceding and 1 preceding), 0) * 2.0::double)
    / (sum(weight) over () - coalesce(sum(weight) over (order by source_size * 2.0::double / weight, place rows between unbounded preceding and 1 preceding), 0)) as lvl from s2),
s4 as (select source, source_size, least(source_size * 2.0::double, weight * max(lvl) over ()) as target from s3),
s5 as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as copies from s4),
g0 as (select source, k, sum(size) as words from d group by source, k),
g1 as (select g0.*, sum(words) over (partition by source order by k) as upto from g0),
g2 as (select g1.source, g1.k, target - copies * source_size as budget, upto, words,
    case when upto <= target - copies * source_size then 1
         when upto - words <= target - copies * source_size and upto - (target - copies * source_size) < (target - copies * source_size) - (upto - words)
              and row_number() over (partition by g1.source, upto > target - copies * source_size order by g1.k) = 1 then 1
         else 0 end as more
  from g1 join s5 on g1.source is not distinct from s5.source)
select doc_id, cast(size as bigint) as size, source_size, target, cast(size * (copies + more) as bigint) as taken
from d join s5 on d.source is not distinct from s5.source
join g2 on d.source is not distinct from g2.source and d.k = g2.k
"""


# ------------------------------------------------------------------------------------ op4

@query
def op4_quality_rules(spark, sf_dir):
    """Base statistics, base rules and the MCD verdict of every document."""
    stats = stored(quality.with_stats(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"]), "stats")
    judged = quality.judge(stats, quality.fit_mcd(stats))
    return judged.select("doc_id", *[F.col(f"qs_{s}").alias(s) for s in
                                     ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                         F.col("qs_base_failed").alias("base_failed"), F.col("qs_kept").alias("kept"),
                         F.col("qs_distance").alias("distance"))


# ------------------------------------------------------------------------------------ op1

@query
def op1_warc(spark, sf_dir):
    """Every page as a WARC record, read back from the archives."""
    back = warc.archive_pages(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


ORACLE["op1_warc"] = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest as d, min(page_id) as first_id from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
  case when first_id <> page_id then 'revisit' else 'response' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from p left join f on payload_digest = d
"""


# ------------------------------------------------------------------------------------ op7

@query
def op7_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate components of all documents."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("digest")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


# ------------------------------------------------------------------------------------ op8

@query
def op8_embedding_near_dedup(spark, sf_dir):
    """Near-duplicate components of all vectors."""
    found = embeddings.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE["op8_embedding_near_dedup"] = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    and list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join comp on comp.a = e.vec_id left join n on n.a = e.vec_id
"""


# ------------------------------------------------------------------------------------ op9

@query
def op9_quality_classifier(spark, sf_dir):
    """Calibrated quality score of every document."""
    features = stored(classifier.with_features(table(spark, sf_dir, "documents")), "features")
    labels = classifier.training_labels(table(spark, sf_dir, "labels"), "quality")
    held = crc_mod(F.col("doc_id"), 3) == 1
    train = stored(features.filter(~held).join(labels, F.col("doc_id") == F.col("label_of")).drop("label_of"), "train")
    scored = classifier.fit_and_score(features, train)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# ------------------------------------------------------------------------------------ op5

@query
def op5_suffix_array_dedup(spark, sf_dir):
    """Repeated 50-byte strings removed from all documents."""
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.col("rp_bytes").alias("n_bytes"), F.col("rp_removed").alias("n_removed"),
                      F.col("rp_spans").alias("n_spans"), F.col("rp_sha256").alias("kept_sha256"))


ORACLE["op5_suffix_array_dedup"] = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
pos as (select doc_id, b, unnest(range(1, cast(length(h) / 2 as bigint) - 48)) as i
  from (select doc_id, h, unhex(h) as b from d) where length(h) >= 100),
win as (select doc_id, i - 1 as i, array_slice(b, i, i + 49) as w from pos),
low as (select w, min(doc_id) as m from win group by w),
hit as (select doc_id, i from win join low using (w) where m < doc_id),
runs as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from hit),
grp as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as g from runs),
spans as (select doc_id, g, min(i) as a, max(i) + 50 as b from grp group by doc_id, g),
pieces as (select s.doc_id, s.a, s.b, coalesce(lag(s.b) over (partition by s.doc_id order by s.a), 0) as prev from spans s),
left_over as (select d.doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' order by a) as part, max(b) as e,
    sum(b - a) as n, count(*) as k from d join pieces p using (doc_id) group by d.doc_id)
select d.doc_id, cast(length(h) / 2 as bigint) as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(k, 0) as n_spans,
  sha256(unhex(case when k is null then h else part || substr(h, 2 * e + 1) end)) as kept_sha256
from d left join left_over using (doc_id)
"""


# ------------------------------------------------------------------------------------ op6

@query
def op6_lm_scoring(spark, sf_dir):
    """Base and model scores of all documents."""
    return ngram.score_documents(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------------------------ op2

@query
def op2_sentencepiece(spark, sf_dir):
    """Every document's pieces, in chunks, with the result of decoding them again."""
    out = pieces.encode_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "chunk_no", "n_chunks", "n_pieces", "ids", "round_trip")


# ----------------------------------------------------------------------------------- op11

@query
def op11_fixed_block_anchors(spark, sf_dir):
    """Repeated windows of 35 words removed from all documents."""
    out = anchors.remove_passages(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc.doc_id", F.col("words").alias("n_words"), F.col("removed").alias("n_removed"),
                      F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op11_fixed_block_anchors"] = r"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select k, i, array_to_string(list_slice(w, i, i + 34), ' ') as g
  from (select k, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
many as (select g from win group by g having count(*) > 1),
gone as (select distinct k, unnest(range(i, i + 35)) as i from win semi join many using (g)),
word as (select k, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
left_over as (select k, count(*) as n, string_agg(x, ' ' order by i) as kept from word anti join gone using (k, i) group by k)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join left_over using (k)
"""


# ----------------------------------------------------------------------------------- op12

def aligned_documents(docs: DataFrame) -> DataFrame:
    """Per document its tokens, groups and links, with the digest of the groups and the links' scores."""
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    rows = stored(align.align(docs, ["doc_id"]).withColumn("groups", digest), "aligned")
    postings = stored(align.merged(rows.filter("rec is null")), "postings")
    counts = stored(align.pair_counts(postings), "pairs")
    found = align.scores(postings, counts).withColumnRenamed("rec", "of_rec")
    out = rows.filter("rec is not null").join(found, F.col("rec") == F.col("of_rec"), "left")
    return out.select("doc.doc_id", *align.NUMBERS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")],
                      F.col("groups").alias("groups_sha256"))


@query
def op12_pair_bitmaps(spark, sf_dir):
    """Alignment of two tokenizers over all documents."""
    return aligned_documents(table(spark, sf_dir, "documents"))


# ----------------------------------------------------------------------------------- op13

@query
def op13_shared_search(spark, sf_dir):
    """The 20 best documents of each benchmark item, of all documents."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op13_shared_search"] = r"""
with d as (select row_number() over () as k, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
tf as (select k, any_value(doc_id) as doc_id, t, count(*) as tf from d group by k, t),
size as (select k, cast(sum(tf) as bigint) as n from tf group by k),
total as (select count(*) as n_docs, cast(sum(n) as bigint) as l from size),
df as (select t, count(*) as df from tf group by t),
i as (select row_number() over () as item, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
q as (select item, any_value(item_id) as item_id, t, count(*) as q from i group by item, t),
part as (select item, item_id, k, doc_id, q * cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1))) as bigint)
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // l))) as s
  from q join df using (t) join tf using (t) join size using (k) cross join total),
score as (select item, any_value(item_id) as item_id, k, any_value(doc_id) as doc_id, cast(sum(s) as bigint) as score from part group by item, k),
ranked as (select *, cast(row_number() over (partition by item order by score desc, doc_id nulls last) as integer) as rank from score where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""
