"""The operators of this package as named queries over the test tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from outlay.llm import (
    ann, chat, hamming_dedup, hard_negatives, mixing, ngram_join, personal, pieces, quality, secret_scan, spans, spelling, toxicity, url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

#: (host, path, verdict) of the url rules.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def _rule_values() -> str:
    return "values " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"select * from {_rule_values()} as r(host, path, verdict)")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_dedup.dedup_embeddings(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[c.alias(n) for n, c in spans.digest("spans", secret_scan.BASE).items()])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[c.alias(n) for n, c in spans.digest("spans", personal.BASE).items()])


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label), "vec_id % 100 = 0")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.words_of(table(spark, sf_dir, "documents"))
    return spelling.spelling_variants(spelling.with_slips(runs, 97))


#: A conversation whose texts hold the template's control strings.
ODD_TEXT = "\\### Assistant: </turn> ok"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ODD_TEXT).alias("text"),
    )
    return chat.digests(*chat.format_chats(given.union(odd)))


_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from texts
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as o from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
  select x, y from common join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * o >= 80 * (a.n + b.n - o)
), edges as (select x, y from links union all select y, x from links),
reach as (select doc_id as a, doc_id as b from documents union select a, y from reach join edges on b = x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from texts left join sizes using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) using (doc_id)
"""

OP2_SQL = rf"""
with recursive rules as (select * from ({_rule_values()}) r(rhost, rpath, verdict)),
pages_ as (
  select page_id, html, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
    case when contains(url, '://') then translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}')
      || regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') end as node
  from pages
), tags as (
  select host, path, node, unnest(regexp_extract_all(html, '<(?:link|meta)\b[^<>]*>', 0, 'is')) as tag from pages_ where node is not null
), hrefs as (
  select host, path, node, trim(replace(case
    when regexp_matches(tag, '^<link\b.*\brel\s*=\s*["'']?[^"''>=]*\bcanonical\b', 'is') then concat(
      regexp_extract(tag, '\bhref\s*=\s*"([^"]*)"', 1, 'is'), regexp_extract(tag, '\bhref\s*=\s*''([^'']*)''', 1, 'is'),
      regexp_extract(tag, '\bhref\s*=\s*([^\s"''>]+)', 1, 'is'))
    when regexp_matches(tag, '^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b', 'is')
      then regexp_extract(tag, '\bcontent\s*=\s*["'']?[\s0-9.]*[;,]\s*url\s*=\s*[''"]?([^"''>]+)', 1, 'is')
    end, '&amp;', '&')) as href from tags
), addresses as (
  select node, case
    when regexp_matches(href, '^[a-z][a-z0-9+.-]*://', 'i') then href
    when starts_with(href, '//') then 'x:' || href
    when regexp_matches(href, '^[a-z][a-z0-9+.-]*:', 'i') or href = '' or starts_with(href, '#') then null
    when starts_with(href, '/') then 'x://' || host || href
    when starts_with(href, '?') then 'x://' || host || path || href
    else 'x://' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || href end as url
  from hrefs where href is not null
), parts as (
  select node, url, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') as head, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path,
    regexp_extract(url, '^.*?://[^/?#]*[^?#]*(.*)$', 1, 's') as rest from addresses
), folded as (
  select *, list_reduce(list_prepend([]::varchar[], list_transform(string_split(path, '/')[2:], lambda s: [s])),
    lambda acc, s: case s[1] when '..' then acc[:greatest(len(acc) - 1, 0)] when '.' then acc else acc || s end) as kept from parts
), targets as (
  select node, case when regexp_matches(path, '/\.\.?(/|$)') and length(url) <= 8192 then head || '/' || array_to_string(kept, '/')
    || case when regexp_matches(path, '/\.\.?$') and len(kept) > 0 then '/' else '' end || rest else url end as url from folded
), links as (
  select distinct node as a, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}')
    || regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') as b from targets where contains(url, '://')
), edges as (select a, b from links where a <> b union select b, a from links where a <> b),
nodes as (select distinct a as node from edges),
reach as (select node as a, node as b from nodes union select reach.a, edges.b from reach join edges on reach.b = edges.a),
places as (
  select distinct host, path from pages_ union
  select regexp_extract(node, '^[^/?]*'), regexp_extract(node, '^[^/?]*([^?]*)', 1) from nodes
), judged as (
  select host, path, rhost || rpath as rule, verdict from places join rules
    on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  qualify row_number() over (partition by host, path order by length(rhost || rpath) desc, verdict, length(rhost) desc) = 1
), spread as (
  select reach.a as node, min(verdict) as inherited from reach
  join judged on judged.host = regexp_extract(reach.b, '^[^/?]*') and judged.path = regexp_extract(reach.b, '^[^/?]*([^?]*)', 1) group by 1
)
select page_id, p.host, p.path, rule, coalesce(verdict, inherited, 'allow') as verdict
from pages_ p left join judged on p.host = judged.host and p.path = judged.path and p.node is not null left join spread on p.node = spread.node
"""

OP5_SQL = """
with recursive good as (
  select vec_id, label, list_transform(embedding, lambda v: v::double) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0
), unit as (select *, sqrt(list_dot_product(e, e)) as length from good),
links as (
  select a.vec_id as x, b.vec_id as y from unit a join unit b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (a.length * b.length) >= 0.98
), reach as (select vec_id as a, vec_id as b from embeddings union select a, y from reach join links on b = x),
parts as (select a, min(b) as component_id from reach group by a),
counts as (select x, count(*) as n from links group by x)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join parts on a = vec_id left join counts on x = vec_id
"""

OP10_SQL = f"""
with docs as (
  select doc_id, source, md5(coalesce(text, '')) as print, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size from documents
), ranked as (
  select source, sum(size)::bigint as words, row_number() over (order by source is null, source) - 1 as sid from docs group by source
), weighed as (select *, ([3, 1, 2])[sid % 3 + 1]::bigint as weight, 2.0::double * words as cap from ranked),
levels as (
  select cap / weight as c, ((select sum(words) from weighed) * 150 / 100.0::double
      - coalesce(sum(words) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0) * 2.0::double)
    / sum(weight) over (order by cap / weight, sid rows between current row and unbounded following) as level
  from weighed
), level as (select coalesce(min_by(level, c) filter (level <= c), 0) as level from levels),
targets as (select sid, source, words, least(cap, weight * level) as target, ((words + 127) // 128)::bigint as blocks from weighed, level),
sources as (
  select *, case when words > 0 then round(target * blocks / words * 1000) else 0 end::bigint as units from targets
), totals as (select sum(units)::bigint as total from sources),
shape as (select total, greatest(1, round_even(total / 1000.0::double / 1024, 0))::bigint as shards from totals),
plan as (select total, shards, round_even(total / 1000.0::double / shards, 0)::bigint as slots from shape),
given as (select sid, units * slots // total as given, units * slots - (units * slots // total) * total as rest from sources, plan where total > 0),
lines as (
  select *, coalesce(sum(given) over w, 0) as from_slot, coalesce(sum(rest) over w, 0) as from_rest from given
  window w as (order by sid rows between unbounded preceding and 1 preceding)
), sums as (select sum(given) as sure, sum(rest)::double as rest from given),
every as (select i // slots as shard, i % slots as slot from plan, range(shards * slots) r(i)),
by_plan as (
  select sid, shard * given + slot - from_slot as i from every, sums, lines where slot < sure and slot >= from_slot and slot < from_slot + given
), points as (
  select shard, slot, ('0x' || substr(md5('slot|' || shard || '|' || slot), 1, 13))::bigint::double / 4503599627370496.0::double * rest as x
  from every, sums where slot >= sure
), by_draw as (
  select sid, given * shards + row_number() over (partition by sid order by shard, slot) - 1 as i
  from points, lines, plan where x >= from_rest::double and x < (from_rest + lines.rest)::double
), taken as (
  select sid, i % blocks as place, count(*) as times from (select * from by_plan union all select * from by_draw) join sources using (sid)
  where i // blocks < 2 group by all
), laid as (
  select docs.*, sid, words, target, coalesce(sum(size) over (partition by sid order by
      md5('document|' || coalesce(doc_id::varchar, '') || '|' || print), doc_id, print, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from docs join sources on docs.source is not distinct from sources.source where size > 0
), pieces as (
  select sid, start, size, unnest(range(start // 128, (start + size - 1) // 128 + 1)) as block from laid
), places as (
  select sid, block, row_number() over (partition by sid order by md5('block|' || sid || '|' || block), block) - 1 as place
  from (select distinct sid, block from pieces)
), mixed as (
  select sid, start, sum(times * (least((block + 1) * 128 - start, size) - greatest(block * 128 - start, 0))) as taken
  from pieces join places using (sid, block) join taken using (sid, place) group by all
)
select doc_id, size, words as source_size, target, coalesce(taken, 0)::bigint as taken from laid left join mixed using (sid, start)
union all
select doc_id, size, words, target, 0 from docs join sources on docs.source is not distinct from sources.source where size = 0
"""

OP11_SQL = """
with whole as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda v: floor(256 * v::double)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
  from whole a join whole b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank,
  id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""

OP12_SQL = f"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{spelling.RUN}')) as run from documents
), counted as (select doc_id, run, count(*) as times from runs group by all
), bytes as (
  select run, times, hex(encode(concat(doc_id, ':', run))) as x from counted
), hashed as (
  select run, times, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) as h from bytes, crc
), words as (
  select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from hashed
), known as (select word, sum(times)::bigint as n from words where length(word) >= 5 group by word having sum(times) >= 3
), cuts as (
  select word, i, left(word, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from known)
), near as (
  select a.word, b.word as near from cuts a join cuts b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select word, rest from cuts where rest in (select word from known)
  union select rest, word from cuts where rest in (select word from known)
), best as (
  select near.word, count(*) as n_near, arg_min(near, (-b.n, near)) as form, max(b.n) as form_n
  from near join known b on b.word = near.near group by near.word
), forms as (
  select word, n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 2 * n then form end as form, case when form_n >= 2 * n then form_n end as form_n
  from known left join best using (word)
), chain as (
  select word, word as root, 0 as step from known union all
  select chain.word, form, step + 1 from chain join forms on forms.word = root where form is not null
)
select word, form, root, n, n_near, form_n from forms join (select word, arg_max(root, step) as root from chain group by word) using (word)
"""

_ESCAPE = r"regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')"

OP13_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), '{ODD_TEXT}'
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('### : </turn>' || chr(10)) + length(regexp_replace(role, '(\\|###|</turn>|: )', '\\\1', 'g')) + length({_ESCAPE}))::bigint as formatted_chars
from turns group by conv_id
"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_ngram_jaccard_join": (op1_ngram_jaccard_join, OP1_SQL),
    "op2_url_filters": (op2_url_filters, OP2_SQL),
    "op3_approximate_nearest_neighbours": (op3_approximate_nearest_neighbours, None),
    "op4_quality_classifier": (op4_quality_classifier, None),
    "op5_embedding_near_dedup": (op5_embedding_near_dedup, OP5_SQL),
    "op6_sentencepiece": (op6_sentencepiece, None),
    "op7_secret_scans": (op7_secret_scans, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_pii": (op9_pii, None),
    "op10_mixing_sources": (op10_mixing_sources, OP10_SQL),
    "op11_hard_negatives": (op11_hard_negatives, OP11_SQL),
    "op12_spelling_variants": (op12_spelling_variants, OP12_SQL),
    "op13_chat_formatting": (op13_chat_formatting, OP13_SQL),
}
