"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.session import table

from . import chat, pii, quality_classifier, toxicity
from .bpe import token_digests
from .collocations import collocations
from .common import in_fold
from .decontaminate import contamination
from .line_dedup import drop_common_lines
from .periodic_runs import most_periods, periodic_runs, with_cycle
from .quality_rules import MEASURES, judged
from .secret_scan import find_secrets, span_digests
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats

VOCABULARY = "byte_bpe_50k.tiktoken"


def tokenizer_files() -> tuple[str, str]:
    """The path of the merge ranks and the splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


#: A record of another layout than the table's; what both say is also a control string of the template.
CONTROL_RECORD = '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turns_of_rows(table(spark, sf_dir, "conversations"))
    record = spark.range(1).select(F.lit(-7).alias("conv_id"), F.lit(CONTROL_RECORD).alias("body"))
    turns = rows.unionByName(chat.turns_of_records(record).drop("layout"))
    return chat.conversation_digests(chat.parsed(chat.formatted(turns)))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=200)
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = in_fold("doc_id", 3, 1)
    model = quality_classifier.train(docs, labels, learn_from=~held_out)
    return quality_classifier.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = tokenizer_files()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(docs, vocabulary=vocabulary, pattern=pattern, max_states=220_000, max_memo=1_400_000).drop("text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle_words=3, max_bits=2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = in_fold("doc_id", 5, 0)
    machine = toxicity.train(docs, labels, learn_from=~held_out)
    return toxicity.scored(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return contamination(docs, benchmark, window=13, hits_per_100=5).drop("text", "longest_at", "longest_item", "longest_item_at")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), least_words=10, repeat_per_100=20)
    return docs.select("doc_id", *MEASURES, "base_failed", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"), max_words=3, min_count=10, absorbed_per_100=50, top=2000)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs(with_cycle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text"), min_words=24, min_periods=3)
    best, lines = most_periods(F.col("runs")), F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    of_best = docs.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).alias("lines"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return of_best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_pii": op13_pii,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_CHAT_SQL = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    -- the template adds 8 + 8 + 7 code points a turn; escaping adds 2 for each control string, 1 for each mark
    SELECT *, length(role || text) + 23
        + (length(role || text) - length(replace(role || text, chr(9243), '')))
        + (length(role) - length(replace(role, '<|', ''))) + (length(text) - length(replace(text, '<|', '')))
        + 2 * (length(text) - length(replace(text, '<s>', ''))) // 3 + 2 * (length(text) - length(replace(text, '</s>', ''))) // 4
        + 2 * (length(text) - length(replace(text, '[INST]', ''))) // 6 + 2 * (length(text) - length(replace(text, '[/INST]', ''))) // 7
        + 2 * (length(text) - length(replace(text, '<<SYS>>', ''))) // 7 + 2 * (length(text) - length(replace(text, '<</SYS>>', ''))) // 8 AS chars
    FROM turns
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_LINES_SQL = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (f.key IS NOT NULL))::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f USING (key) GROUP BY doc_id
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
wins AS (
    SELECT item_id, item_row, i AS place, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM (SELECT *, row_number() OVER () AS item_row FROM b) WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
found AS (SELECT p.doc_id, p.n, p.i, wins.item_id, wins.item_row, wins.place FROM places p JOIN wins USING (n, win)),
-- windows one after the other in the document and in the item are one match
runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_row, n, i - place ORDER BY i) AS run FROM found),
longest AS (
    SELECT doc_id, max(words) AS words
    FROM (SELECT doc_id, n + count(*) - 1 AS words FROM runs GROUP BY doc_id, item_row, n, i - place, run) GROUP BY doc_id
),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(longest.words, 0)::BIGINT AS longest_match, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

_RULES_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
),
grams AS (SELECT doc_id, i, w[i : i + 4] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, gram FROM grams GROUP BY doc_id, gram HAVING count(*) > 1),
repeats AS (
    SELECT doc_id, count(DISTINCT pos) AS n
    FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM grams JOIN twice USING (doc_id, gram)) GROUP BY doc_id
),
base AS (
    SELECT doc_id, text, len(lines) AS n_lines, len(w)::BIGINT AS n_words,
        length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
            - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
        coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
        length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters,
        length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS capitals
    FROM d LEFT JOIN repeats USING (doc_id)
),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > word_chars OR word_chars > 60 * n_words OR 10 * n_dup_lines > 3 * n_lines
        OR 10 * letters < 5 * word_chars OR 2 * capitals > letters) AS kept
FROM failed
"""

_COLLOCATIONS_SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
counts AS (
    SELECT lang, m, phrase, count(*) AS f
    FROM (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (VALUES (1), (2), (3)) sizes(m) WHERE len(w) >= m))
    GROUP BY lang, m, phrase
), total AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : m], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scored AS (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
    SELECT lang, phrase, max(f) AS most, max(f) FILTER (place = 2) AS left_most, max(f) FILTER (place = 1) AS right_most
    FROM (SELECT lang, f, place, array_to_string(w[place : place + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS place FROM candidates WHERE m = 3))
    GROUP BY lang, phrase
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
    score::BIGINT AS score, coalesce(left_most, 0)::BIGINT AS left_most, coalesce(right_most, 0)::BIGINT AS right_most
FROM best LEFT JOIN around USING (lang, phrase) JOIN total USING (lang)
WHERE coalesce(100 * most < 50 * a, true)
QUALIFY rank <= 2000
"""

#: The other operators have no SQL: hashes, merges or learned scores that SQL doesn't have; tests use brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": _CHAT_SQL,
    "op4_line_dedup": _LINES_SQL,
    "op9_decontamination": _CONTAMINATION_SQL,
    "op10_quality_rules": _RULES_SQL,
    "op11_collocations": _COLLOCATIONS_SQL,
}
