"""The operators applied to whole tables with production parameters, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, secrets, toxicity
from .common import fold, table
from .conversations import conversation_trie
from .decontaminate import contaminated
from .mixing import mix, mixing_sql
from .ngram_join import near_duplicates
from .packing import packed
from .passages import repeated_passages
from .phrases import collocations
from .ppm import model_scores
from .quality import host_rules
from .token_files import token_files


def op1_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of all documents under PPM trained on those of other remainders than 2 (crc32 mod 7)."""
    return model_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7, 2))


def op2_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of remainder 2 (crc32 mod 4) are not learned."""
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4, 2)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out), held_out)


def op4_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of all documents."""
    return secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; those of remainder 2 (crc32 mod 4) are not learned."""
    return language.identify(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4, 2))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of all documents and their hosts' verdicts."""
    return host_rules(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that are like benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weights and the sample of all documents."""
    return mix(table(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across all documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with the beginnings of their families."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


def op12_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 ids, a row a piece."""
    pieces = packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OP3_SQL = r"""
with d as (select row_number() over () rid, doc_id, source host, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from d),
tri as (select rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] g from (select rid, ws, unnest(range(1, len(ws) - 1)) i from w)),
rep as (select rid, i from (select *, count(*) over (partition by rid, g) c from tri) where c > 1),
pos as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from rep) group by 1),
ln as (select rid, count(*) - count(distinct l) n from (select rid, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1),
m as (select w.rid, doc_id, host, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(ln.n, 0)::bigint n_dup_lines, coalesce(pos.n, 0)::bigint n_repeat_words
  from w left join pos using (rid) left join ln using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, n_words < 50 or 100 * n_repeat_words > 50 * n_words or n_symbols > n_words or 20 * n_dup_lines > n_words rule_failed from m),
h as (select host, count(*) host_docs, sum(rule_failed::int) host_failed from f where host is not null group by 1),
s as (select avg(host_failed / host_docs) mean, var_pop(host_failed / host_docs) var, avg(1 / host_docs) inv from h),
b as (select mean, mean * (1 - mean) spread, least(greatest(var - mean * (1 - mean) * inv, mean * (1 - mean) / 200), mean * (1 - mean) / 1.5) btw from s),
ab as (select case when mean > 0 and mean < 1 then mean * (spread / btw - 1) else 1.0 end a, case when mean > 0 and mean < 1 then (1 - mean) * (spread / btw - 1) else 1.0 end b from b),
r as (select host, (host_failed + a) / (host_docs + a + b) host_rate from h, ab)
select doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule_failed, round(host_rate, 6) host_rate, not base_failed and coalesce(host_rate, 0) <= 0.5 kept
from f left join r using (host)
"""

OP11_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
k as (select conv_id, md5(length(r) || ':' || r || x) key, length(x) chars, row_number() over (partition by conv_id order by turn nulls first, md5(length(r) || ':' || r || x)) pos from t),
c as (select conv_id, count(*) n, conv_id - conv_id % 100 base,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::bigint)), lambda u, v: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) % 6 h from k group by 1),
g as (select c.*, least(h, coalesce(b.n, 0)) got from c left join (select conv_id base, n from c) b using (base)),
s as (select g.conv_id, pos d, key, chars from g join k on k.conv_id = g.base and pos <= got union all select conv_id, pos - h + got, key, chars from g join k using (conv_id) where pos > h),
p as (select *, string_agg(key, '') over (partition by conv_id order by d) prefix, max(d) over (partition by conv_id) len from s),
m as (select conv_id, d, prefix, chars, d = len last from p union all select conv_id, 0, '', 0, conv_id not in (select conv_id from s) from g),
n as (select d, prefix, min(conv_id) conv_id, count(*) n_convs, max(chars) chars, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) ends_sha256 from m group by all),
q as (select n.*, exists (select 1 from n e where e.d = n.d + 1 and left(e.prefix, 32 * n.d) = n.prefix) inner_ from n),
up as (select left(prefix, 32 * a) prefix, a d, sum((not inner_)::int) n_leaves, sum((n_convs - 1) * chars) saved_tokens, count(*) filter (d = a + 1) n_children from (select *, unnest(range(0, d + 1)) a from q) group by all)
select n.conv_id, n.d::bigint depth, f.conv_id parent_conv_id, n.n_convs, n_children::bigint n_children, n_leaves::bigint n_leaves, saved_tokens::bigint saved_tokens, n.ends_sha256
from n join up using (d, prefix) left join n f on f.d = n.d - 1 and f.prefix = left(n.prefix, 32 * (n.d - 1))
"""

OP13_SQL = r"""
with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from p),
g as (select lang, k, list_aggregate(ws[i : i + k - 1], 'string_agg', ' ') phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) i from w, range(1, 4) t(k) where len(ws) >= k)),
f as (select lang, k, phrase, count(*) f from g group by all having count(*) >= 10),
n as (select lang, sum(len(ws)) n from w group by 1),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') ws, unnest(range(1, k)) cut from f where k > 1),
s as (select c.*, l.f l, r.f r, (1000000::hugeint * a * a) // (l.f::hugeint * r.f) score from c
  join f l on l.lang = c.lang and l.phrase = list_aggregate(ws[1 : cut], 'string_agg', ' ') join f r on r.lang = c.lang and r.phrase = list_aggregate(ws[cut + 1 :], 'string_agg', ' ')),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, cut) o from s) where o = 1),
o as (select lang, phrase, max(a) outer_ from (select lang, a, unnest([list_aggregate(ws[1:2], 'string_agg', ' '), list_aggregate(ws[2:3], 'string_agg', ' ')]) phrase from b where k = 3) group by 1, 2),
t as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) rank from b left join o using (lang, phrase) where outer_ is null or 100 * outer_ < 50 * a)
select t.lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n.n::bigint n, score::bigint score from t join n using (lang) where rank <= 2000
"""

QUERIES = {"op12_packed_sequences": op12_packed_sequences, "op13_phrase_collocations": op13_phrase_collocations, "op11_conversation_trie": op11_conversation_trie, "op10_repeated_passages": op10_repeated_passages, "op1_ppm_scores": op1_ppm_scores, "op7_benchmark_decontamination": op7_benchmark_decontamination, "op8_token_files": op8_token_files, "op9_mixing": op9_mixing, "op6_ngram_jaccard_join": op6_ngram_jaccard_join, "op2_factorization_toxicity": op2_factorization_toxicity, "op4_token_efficiency_secrets": op4_token_efficiency_secrets, "op5_naive_bayes_language": op5_naive_bayes_language, "op3_host_rules": op3_host_rules}
ORACLES = {"op13_phrase_collocations": OP13_SQL, "op11_conversation_trie": OP11_SQL, "op9_mixing": mixing_sql(), "op3_host_rules": OP3_SQL}
