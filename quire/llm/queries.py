"""The registered queries of the package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, differencing, html_text, lexical, licenses, mixing, planes, quality, simhash, toxicity, turns, url_filter, vector_graph
from quire.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(made: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = made
        if sql is not None:
            ORACLES[name] = sql
        return made

    return register


@query("op2_simhash_trie")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(read(spark, folder, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


_OP8_SQL = r"""
with docs as (
  select row_number() over () as rid, doc_id, source as host, coalesce(text, '') as text, md5(coalesce(text, '')) as k,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
base as (
  select rid, doc_id, host, k, text, words, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols
  from docs),
split as (select rid, host, k, n_words, unnest(string_split(text, chr(10))) as line from base),
lines as (
  select rid, host, k, n_words, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as parts from split where regexp_matches(line, '[^\x20\x09-\x0D]')),
dups as (select rid, (count(*) - count(distinct line))::bigint as n from lines group by rid),
windows as (
  select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w from (select rid, words, unnest(range(1, len(words) - 1)) as i from base)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, w) as n from windows) where n > 1),
repeats as (select rid, count(distinct i + d)::bigint as n from twice, (values (0), (1), (2)) as t(d) group by rid),
normal as (select rid, host, k, n_words, array_to_string(parts, ' ') as line, len(parts) as w from lines),
sized as (
  select distinct host, k, line,
    length(bin(n_words)) * 16 + ((n_words >> greatest(length(bin(n_words)) - 5, 0)::bigint) & 15) as size from normal),
hosts as (select host, count(distinct k) as n from base group by host),
often as (
  select host, line from (select host, line, count(distinct k) as texts, count(distinct size) as classes from sized group by host, line) s
  join hosts h using (host) where texts > 20 and classes > 8 and texts > h.n * 0.001),
lost as (select rid, sum(w)::bigint as n from normal join often using (host, line) group by rid),
result as (
  select doc_id, n_words, word_chars, n_symbols, coalesce(d.n, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
    coalesce(l.n, 0)::bigint as removed_words
  from base left join dups d using (rid) left join repeats r using (rid) left join lost l using (rid)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from result)
select *, not base_failed and 5 * (n_words - removed_words) >= n_words as kept from failed
"""


@query("op8_line_frequency", _OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(read(spark, folder, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


@query("op10_restored_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = toxicity.train(docs, read(spark, folder, "labels"))
    scored = toxicity.toxicity(docs, model)
    return scored.select(
        F.col("id").alias("doc_id"), (~toxicity.in_training(F.col("id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_splitting_tree_mix")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix_plan(read(spark, folder, "documents"))
    taken = F.col("size") * F.size("copies")
    rows = plan.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"))


@query("op4_tree_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    made = bpe.encode_digests(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return made.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


@query("op5_bit_planes")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    made = planes.planes_round_trip(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return made.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op9_minimum_cut_text")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    made = html_text.extract(read(spark, folder, "pages"))
    return made.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


_OP6_SQL = r"""
with rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
hosts as (select page_id, r, regexp_extract(coalesce(r, ''), '^[^/?#]*') as h from rest),
urls as (
  select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(coalesce(r, ''), length(h) + 1), '^[^?#]*') as path
  from hosts),
fits as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from urls),
shaped as (
  select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 1 when rule is not null then 0 end as blocked,
    array_to_string(list_transform(list_filter(string_split(path, '/'), lambda p: p <> ''), lambda p: case
      when regexp_matches(p, '^[0-9a-fA-F]{8,}$|^[0-9a-fA-F-]{36}$') then '{h}' else regexp_replace(p, '[0-9]+', '{n}', 'g') end), '/') as shape
  from fits),
paths as (select host, shape, string_split(shape, '/') as parts, count(blocked) as n, count(case when blocked = 1 then 1 end) as b from shaped group by host, shape),
steps as (select host, shape, parts, unnest(range(1, len(parts) + 1)) as i from paths),
named as (select host, shape, i, parts[i] as part, array_to_string(parts[1:i - 1], '/') as before from steps),
wide as (
  select host, i, before from named where not contains(part, '{') group by host, i, before having count(distinct part) > 32),
general as (
  select n.host, n.shape, i, case when w.host is not null and not contains(part, '{') then '*' else part end as part
  from named n left join wide w using (host, i, before)),
whole as (select host, shape, list(part order by i) as t from general group by host, shape),
leaves as (select host, shape, array_to_string(t[1:len(t) - 1], '/') as node, t[len(t)] as branch from whole),
branches as (select host, node, branch, sum(n) as n, sum(b) as b from paths join leaves using (host, shape) group by host, node, branch),
nodes as (select host, node, case when sum(n) > 0 then sum(b)::double / sum(n) end as p from branches group by host, node),
merged as (
  select host, node, branch, n, b,
    case when n > 0 and abs(b::double / n - p) <= 1.96 * sqrt(p * (1 - p) / n) then '*' else branch end as merged
  from branches join nodes using (host, node)),
overall as (select case when sum(n) > 0 then sum(b)::double / sum(n) else 0.5 end as share from paths),
sums as (select host, node, merged, sum(n) as n, sum(b) as b from merged group by host, node, merged),
groups as (select host, node, merged, n > 0 and (b + 5.0 * share) / (n + 5.0) > 0.8 as rejected from sums, overall)
select page_id, s.host, path, rule, case when node = '' then '' else node || '/' end || g.merged as template,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when rejected then 'block' else 'allow' end as verdict
from shaped s join leaves l using (host, shape) join merged m using (host, node, branch) join groups g using (host, node, merged)
"""


@query("op6_path_template_tree", _OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, folder, "pages")).withColumnRenamed("id", "page_id")


@query("op7_fuzzy_notices")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, folder, "documents"))
    base, labels = F.col("phrases.label"), F.concat(F.col("phrases.label"), F.col("notices.label"))

    def listed(names):
        return F.array_join(F.array_sort(F.array_distinct(names)), ",")

    exact = F.when(F.size("phrases") > 0, 1.0).otherwise(0.0)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.first").alias("first_word"),
        F.array_max("phrases.first").alias("last_word"), listed(base).alias("base_labels"), listed(labels).alias("labels"),
        F.greatest(exact, F.coalesce(F.array_max("notices.score"), F.lit(0.0))).alias("score"))


_OP1_SQL = """
with recursive good as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.9),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
lowest as (select a, min(b) as low from reach group by a),
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, low as component_id, vec_id = low as kept
from embeddings join lowest l on l.a = vec_id left join counts c on c.a = vec_id
"""


@query("op1_vector_graph", _OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    groups = vector_graph.vector_groups(read(spark, folder, "embeddings"))
    return groups.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


_OP11_SQL = r"""
with said as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents),
docs as (select rid, doc_id, words, len(words)::bigint as n from said where len(words) > 0),
whole as (select count(*)::bigint as n_docs, sum(n)::bigint as l from docs),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
postings as (
  select rid, term, count(*)::bigint as tf from (select rid, unnest(words) as term from docs) w where term in (select term from asked) group by rid, term),
weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, whole group by term, n_docs),
parts as (
  select item_id, rid, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l))) as s
  from postings join weights using (term) join docs using (rid) join asked using (term), whole),
scores as (select item_id, doc_id, rid, sum(s)::bigint as score from parts join docs using (rid) group by item_id, doc_id, rid),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as r, doc_id, score from scores where score > 0)
select item_id, r::int as rank, doc_id, score from ranked where r <= 10
"""


@query("op11_presence_masks", _OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


_OP12_SQL = r"""
with recursive steps as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, list_transform(range(8), lambda k: k::bigint)),
    lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as t),
raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda ch: ascii(ch)::bigint)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::bigint) % 20 as fault
  from conversations, steps),
hurt as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case when fault = 3 then [0, 1] else [0] end) as copy from raw where fault <> 0) d),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as pos, regexp_matches(text, '[^\x20\x09-\x0D]') as worded
  from hurt),
rows as (
  select *, case when not worded then 'blank' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' end as why,
    lag(role) over (partition by conv_id order by pos) as earlier
  from placed),
facts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(case when why = 'blank' then 1 end) as blank,
    count(case when why = 'duplicate' then 1 end) as duplicate, count(case when why = 'truncated' then 1 end) as truncated,
    count(case when earlier is not null and (substr(earlier, 1, 1) || substr(role, 1, 1)) not in ('su', 'ua', 'au') then 1 end) as illegal
  from rows group by conv_id),
dp as (
  select conv_id, 0::bigint as pos, 0::bigint as c0, '' as a0, '' as p0, 999999::bigint as c1, '' as a1, '' as p1, 5::bigint as c2, 'I' as a2, 'user:' as p2, 10::bigint as c3, 'II' as a3, 'user:' || chr(10) || 'assistant:' as p3
  from facts
  union all
  select conv_id, pos, n0.c, n0.a, n0.p, n1.c, n1.a, n1.p, m2.c, m2.a, m2.p, m3.c, m3.a, m3.p from (
    select *, least(n2, {'c': least(n0, n1).c + 5, 'a': least(n0, n1).a || 'I', 'p': case when least(n0, n1).p = '' then '' else least(n0, n1).p || chr(10) end || 'user:'},
        {'c': n3.c + 5, 'a': n3.a || 'I', 'p': case when n3.p = '' then '' else n3.p || chr(10) end || 'user:'}) as m2,
      least(n3, {'c': least(n2, {'c': least(n0, n1).c + 5, 'a': least(n0, n1).a || 'I', 'p': case when least(n0, n1).p = '' then '' else least(n0, n1).p || chr(10) end || 'user:'}).c + 5,
        'a': least(n2, {'c': least(n0, n1).c + 5, 'a': least(n0, n1).a || 'I', 'p': case when least(n0, n1).p = '' then '' else least(n0, n1).p || chr(10) end || 'user:'}).a || 'I',
        'p': least(n2, {'c': least(n0, n1).c + 5, 'a': least(n0, n1).a || 'I', 'p': case when least(n0, n1).p = '' then '' else least(n0, n1).p || chr(10) end || 'user:'}).p || chr(10) || 'assistant:'}) as m3
    from (
      select conv_id, pos, {'c': c0 + 2, 'a': a0 || 'D', 'p': p0} as n0,
        least({'c': c1 + 2, 'a': a1 || 'D', 'p': p1}, case when i = 's' and free then {'c': c0 + f, 'a': a0 || 'K', 'p': g0 || role || ':' || text} else {'c': 999999::bigint, 'a': '', 'p': ''} end) as n1,
        least({'c': c2 + 2, 'a': a2 || 'D', 'p': p2},
          case when free then least({'c': c0 + f + k, 'a': a0 || e, 'p': g0 || u}, {'c': c1 + f + k, 'a': a1 || e, 'p': g1 || u}, {'c': c3 + f + k, 'a': a3 || e, 'p': g3 || u}) else {'c': 999999::bigint, 'a': '', 'p': ''} end) as n2,
        least({'c': c3 + 2, 'a': a3 || 'D', 'p': p3}, case when free then {'c': c2 + f + ka, 'a': a2 || ea, 'p': g2 || v} else {'c': 999999::bigint, 'a': '', 'p': ''} end) as n3
      from (
        select d.*, r.pos as pos, r.role, r.text, substr(r.role, 1, 1) as i, coalesce(r.why, '') not in ('blank', 'duplicate') as free, case when r.why = 'truncated' then 5 else 0 end as f,
          case when substr(r.role, 1, 1) = 'u' then 0 else 1 end as k, case when substr(r.role, 1, 1) = 'u' then 'K' else 'R' end as e,
          case when substr(r.role, 1, 1) = 'u' then r.role else 'user' end || ':' || r.text as u,
          case when substr(r.role, 1, 1) = 'a' then 0 else 1 end as ka, case when substr(r.role, 1, 1) = 'a' then 'K' else 'R' end as ea,
          case when substr(r.role, 1, 1) = 'a' then r.role else 'assistant' end || ':' || r.text as v,
          case when a0 = repeat('D', length(a0)) then '' else p0 || chr(10) end as g0, p1 || chr(10) as g1, p2 || chr(10) as g2, p3 || chr(10) as g3
        from (select conv_id, pos as before, c0, a0, p0, c1, a1, p1, c2, a2, p2, c3, a3, p3 from dp) d join rows r on r.conv_id is not distinct from d.conv_id and r.pos = d.before + 1) s) t) z),
done as (
  select dp.conv_id, least({'c': c0, 'a': a0, 'p': p0}, {'c': c3, 'a': a3, 'p': p3}) as best
  from dp join facts f on f.conv_id is not distinct from dp.conv_id and f.n = dp.pos)
select ids.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(best.p, '')) as repaired_sha256
from (select distinct conv_id from conversations) ids left join facts f on f.conv_id is not distinct from ids.conv_id left join done d on d.conv_id is not distinct from ids.conv_id
"""


@query("op12_block_tables", _OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    conversations = read(spark, folder, "conversations")
    return turns.audits(conversations, turns.repair(turns.damage(conversations))).withColumnRenamed("conv", "conv_id")


@query("op13_differencing")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    placed = differencing.shard_slots(read(spark, folder, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
