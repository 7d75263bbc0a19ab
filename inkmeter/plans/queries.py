"""Registered queries over the driver's tables, each over whole tables and whole texts.

There is no recognised text in the tables, so it is derived: texts are cut into lines of twelve words, as on a
page, and the same chain of plain replacements stands for a recogniser in Spark and in the oracle's SQL. Edit
scripts are compared on ``benchmark``, whose whole texts an SQL dynamic programme can align.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmeter.functions import distance as D
from inkmeter.functions import strings as S
from inkmeter.functions import unicode_text as U
from inkmeter.operators import aggregate as A
from inkmeter.operators import differences as X
from inkmeter.operators import layout as L
from inkmeter.operators import pairing as P
from inkmeter.plans.compare import measure, render
from inkmeter.plans.summarize import summary as summary_of
from inkmeter.sinks.files import write_rows
from inkmeter.sources import files as R
from inkmeter.sources.staging import read_table, scratch_path

WORDS_PER_LINE = 12
#: What the stand-in recogniser gets wrong: replaced, lost and doubled characters.
NOISE = (("rn", "m"), ("e", "c"), ("th", "t"), ("an", "aan"), (", ", " "))

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def noisy(text: Column, number: Column) -> Column:
    for old, new in NOISE:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.concat(text, F.when(number % 3 == 0, F.lit("ß")).otherwise(F.lit("")))


def documents_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``l``, their whole text as an array of lines of twelve words.

    The words pass through a one-element explode, so that they are split once a row and not once a line.
    """
    words = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), " ", -1)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.explode(F.array(words)).alias("w"))
    last = F.floor((F.size("w") - 1) / WORDS_PER_LINE).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice("w", k * WORDS_PER_LINE + 1, F.lit(WORDS_PER_LINE)), " "))
    return rows.select("doc_id", "lang", "source", cut.alias("l"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents_in_lines(spark, sf_dir).select("doc_id", "lang", "source", F.posexplode("l").alias("line_no", "gt"))
    rows = rows.withColumn("line_no", F.col("line_no").cast("long"))
    return rows.withColumn("ocr", noisy(F.col("gt"), F.col("doc_id") + F.col("line_no")))


def bench_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("gt"))
    return rows.withColumn("ocr", noisy(F.col("gt"), F.col("item_id")))


def bench_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(bench_pairs(spark, sf_dir), "gt", "ocr", alignments=True)


def _noisy_sql(text: str, number: str) -> str:
    for old, new in NOISE:
        text = f"replace({text}, '{old}', '{new}')"
    return f"concat({text}, CASE WHEN {number} % 3 = 0 THEN 'ß' ELSE '' END)"


_LINES = f"""words_of AS (SELECT *, string_split(replace(coalesce(text, ''), chr(10), ' '), ' ') AS w FROM documents),
cut AS (SELECT *, list_transform(range(0, (len(w) + {WORDS_PER_LINE - 1}) // {WORDS_PER_LINE}), lambda k: array_to_string(w[k * {WORDS_PER_LINE} + 1 : k * {WORDS_PER_LINE} + {WORDS_PER_LINE}], ' ')) AS l FROM words_of),
bare AS (SELECT doc_id, lang, source, unnest(l) AS gt, (generate_subscripts(l, 1) - 1)::BIGINT AS line_no FROM cut),
lines AS (SELECT *, {_noisy_sql('gt', '(doc_id + line_no)')} AS ocr FROM bare)"""


def _words_sql(text: str) -> str:
    """UAX #29 words of the driver's corpus in the regular expressions that SQL has."""
    for a, b in ((r"\p{L}", r"\p{Nd}"), (r"\p{Nd}", r"\p{L}")):
        text = rf"regexp_replace({text}, '({a})([.,])({b})', '\1 \2 \3', 'g')"
    return rf"regexp_extract_all({text}, '[\p{{L}}\p{{M}}\p{{N}}_]+(?:(?:[.''’:·]\p{{L}}|[.,;''’]\p{{Nd}})[\p{{L}}\p{{M}}\p{{N}}_]*)*')"


def _dist_sql(a: str, b: str) -> str:
    """Distance of two token lists: tokens become single-byte characters, since SQL compares bytes."""
    spelt = lambda t: f"list_transform([list_distinct({a} || {b})], lambda k: array_to_string(list_transform({t}, lambda x: chr(list_position(k, x)::INT)), ''))[1]"
    return f"levenshtein({spelt(a)}, {spelt(b)})::BIGINT"


def _rate_sql(d: str, n: str) -> str:
    return f"CASE WHEN {d} = 0 THEN 0.0::DOUBLE WHEN {n} = 0 THEN 'inf'::DOUBLE ELSE {d}::DOUBLE / {n} END"


_TOKENS = f"""tokens AS (SELECT *, string_split(gt, '') AS gc, string_split(ocr, '') AS oc, {_words_sql('gt')} AS gw, {_words_sql('ocr')} AS ow FROM lines),
measured AS (SELECT *, {_dist_sql('gc', 'oc')} AS c_dist, len(gc)::BIGINT AS n_characters, {_dist_sql('gw', 'ow')} AS w_dist, len(gw)::BIGINT AS n_words
  FROM (SELECT * REPLACE (CASE WHEN gt = '' THEN [] ELSE gc END AS gc, CASE WHEN ocr = '' THEN [] ELSE oc END AS oc) FROM tokens))"""

_BENCH = f"""lines AS (SELECT item_id, gt, {_noisy_sql('gt', 'item_id')} AS ocr FROM (SELECT item_id, coalesce(text, '') AS gt FROM benchmark)),
{_TOKENS}"""


def _walk_sql(a: str, b: str) -> str:
    """The canonical alignment in SQL: the matrix diagonal by diagonal, then a trace from its end."""
    return f"""p AS MATERIALIZED (SELECT item_id AS id, {a} AS a, {b} AS b, len({a}) AS n, len({b}) AS m FROM measured),
diag AS (
  SELECT id, a, b, n, m, 0::BIGINT AS d, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE 1000000 END) AS cur,
         list_transform(range(0, n + 1), lambda i: 1000000) AS prev FROM p
  UNION ALL
  SELECT id, a, b, n, m, d + 1, list_transform(range(0, n + 1), lambda i: CASE WHEN i > d + 1 OR d + 1 - i > m THEN 1000000 WHEN i = d + 1 OR i = 0 THEN (d + 1)::INT
           ELSE least(cur[i] + 1, cur[i + 1] + 1, prev[i] + CASE WHEN a[i] = b[d + 1 - i] THEN 0 ELSE 1 END) END), cur
  FROM diag WHERE d < n + m),
cells AS MATERIALIZED (SELECT id, d, cur FROM diag),
walk AS (
  SELECT id, n AS i, m AS j, 0::BIGINT AS step, NULL::VARCHAR AS op FROM p
  UNION ALL
  SELECT id, i - CASE WHEN o = 'insert' THEN 0 ELSE 1 END, j - CASE WHEN o = 'delete' THEN 0 ELSE 1 END, step + 1, o FROM (
    SELECT w.id, w.i, w.j, w.step, CASE WHEN w.i > 0 AND w.j > 0 AND p.a[w.i] = p.b[w.j] THEN 'match' WHEN w.i > 0 AND c.cur[w.i + 1] = b.cur[w.i] + 1 THEN 'delete'
             WHEN w.j > 0 AND c.cur[w.i + 1] = b.cur[w.i + 1] + 1 THEN 'insert' ELSE 'replace' END AS o
    FROM walk w JOIN p ON p.id = w.id JOIN cells c ON c.id = w.id AND c.d = w.i + w.j JOIN cells b ON b.id = w.id AND b.d = w.i + w.j - 1)),
aligned AS (
  SELECT w.id AS item_id, (max(step) OVER (PARTITION BY w.id) - step)::BIGINT AS pos, op, i::BIGINT AS i, j::BIGINT AS j,
         CASE WHEN op <> 'insert' THEN p.a[i + 1] END AS gt, CASE WHEN op <> 'delete' THEN p.b[j + 1] END AS ocr
  FROM walk w JOIN p ON p.id = w.id WHERE op IS NOT NULL)"""


_ALIGN_C = f"WITH RECURSIVE {_BENCH}, {_walk_sql('gc', 'oc')}"
_ALIGN_W = f"WITH RECURSIVE {_BENCH}, {_walk_sql('gw', 'ow')}"


def _sbb_sql(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"nfc_normalize({text})"
    for old, new in U.LIGATURES + U.EQUIVALENCES:
        text = f"replace({text}, {quote(old)}, {quote(new)})"
    return f"nfc_normalize({text})"


# ---------------------------------------------------------------- metrics


@query(f"WITH {_LINES}, {_TOKENS} SELECT lang, count(*)::BIGINT AS n_lines, sum(c_dist)::BIGINT AS c_dist, sum(n_characters)::BIGINT AS n_characters, {_rate_sql('sum(c_dist)', 'sum(n_characters)')} AS cer FROM measured GROUP BY lang")
def flagship_cer_by_lang(spark, sf_dir):
    """Length-weighted character error rate by language, from integer sums that combine before the shuffle."""
    counted = lines(spark, sf_dir).select("lang", D.cer("gt", "ocr").alias("m")).select("lang", F.col("m.d").alias("c_dist"), F.col("m.n").alias("n_characters"))
    return counted.groupBy("lang").agg(
        F.count("*").alias("n_lines"), F.sum("c_dist").alias("c_dist"), F.sum("n_characters").alias("n_characters"), D.rate(F.sum("c_dist"), F.sum("n_characters")).alias("cer"))


@query(f"WITH {_LINES}, {_TOKENS} SELECT doc_id, line_no, c_dist AS d, n_characters AS n, {_rate_sql('c_dist', 'n_characters')} AS rate FROM measured")
def cer(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", D.cer("gt", "ocr").alias("m")).select("doc_id", "line_no", F.col("m.d").cast("long").alias("d"), F.col("m.n").cast("long").alias("n"), "m.rate")


@query(f"WITH {_LINES}, {_TOKENS} SELECT doc_id, line_no, w_dist AS d, n_words AS n, {_rate_sql('w_dist', 'n_words')} AS rate FROM measured")
def wer(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", D.wer("gt", "ocr").alias("m")).select("doc_id", "line_no", F.col("m.d").cast("long").alias("d"), F.col("m.n").cast("long").alias("n"), "m.rate")


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, {_noisy_sql("coalesce(text, '')", 'doc_id')} AS y FROM documents),
d AS (SELECT doc_id, CASE WHEN x = '' THEN [] ELSE string_split(x, '') END AS a, CASE WHEN y = '' THEN [] ELSE string_split(y, '') END AS b FROM t) SELECT doc_id, {_dist_sql('a', 'b')} AS d FROM d""")
def str_distance(spark, sf_dir):
    """Character distance of whole texts, long ones by the bit-parallel kernel; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("a"), noisy(text, F.col("doc_id")).alias("b"))
    return docs.select("doc_id", D.str_distance("a", "b").cast("long").alias("d"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, {_dist_sql(chr(34) + 'a' + chr(34), chr(34) + 'b' + chr(34))} AS d FROM (SELECT *, string_split(gt, ' ') AS a, string_split(ocr, ' ') AS b FROM lines)")
def seq_distance(spark, sf_dir):
    """Distance of blank-separated tokens, on the JVM."""
    rows = lines(spark, sf_dir).select("doc_id", "line_no", F.split("gt", " ", -1).alias("a"), F.split("ocr", " ", -1).alias("b"))
    return rows.select("doc_id", "line_no", D.jvm_distance("a", "b").cast("long").alias("d"))


@query(f"WITH {_LINES}, {_TOKENS}, r AS (SELECT *, {_rate_sql('c_dist', 'n_characters')} AS er FROM measured) SELECT doc_id, line_no, CASE WHEN n_characters > 0 THEN ceil(er * n_characters)::BIGINT END AS hint FROM r WHERE NOT (n_characters = 0 AND er = 0) OR n_characters = 0")
def score_hint(spark, sf_dir):
    rows = measure(lines(spark, sf_dir), "gt", "ocr")
    hint = D.score_hint(F.when(F.col("n_characters") > 0, F.col("cer")).otherwise(F.lit(float("inf"))), F.col("n_characters"))
    return rows.select("doc_id", "line_no", hint.cast("long").alias("hint"))


# ---------------------------------------------------------------- text


_MARKED = (("é", "é"), ("è", "è"), ("ê", "ê"), ("ü", "ü"), ("ö", "ö"), ("ä", "ä"), ("ñ", "ñ"), ("ó", "ó"))


def _marked_sql(text: str) -> str:
    for old, new in _MARKED:
        text = f"replace({text}, '{old}', '{new}')"
    return text


@query(f"SELECT doc_id, length({_marked_sql('text')})::BIGINT AS n_before, length(nfc_normalize({_marked_sql('text')}))::BIGINT AS n_after, md5(nfc_normalize({_marked_sql('text')})) AS digest FROM documents")
def nfc(spark, sf_dir):
    """Whole texts, taken apart into letters and marks, composed again."""
    text = F.col("text")
    for old, new in _MARKED:
        text = F.replace(text, F.lit(old), F.lit(new))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("t")).withColumn("c", U.nfc("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_before"), F.length("c").cast("long").alias("n_after"), F.md5(F.encode("c", "UTF-8")).alias("digest"))


_OLD_PRINT = (("fi", "ﬁ"), ("st", "ﬆ"), ("ch", ""), ("ü", "uͤ"), ("ä", ""), ("qu", ""), (" - ", " — "), ("ss", ""))


def _old_print_sql(text: str) -> str:
    for old, new in _OLD_PRINT:
        text = f"replace({text}, '{old}', '{new}')"
    return text


@query(f"SELECT doc_id, md5({_sbb_sql(_old_print_sql('text'))}) AS digest FROM documents")
def nfc_sbb(spark, sf_dir):
    """Whole texts, set as a historical print, brought to the substituting normal form."""
    text = F.col("text")
    for old, new in _OLD_PRINT:
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(U.nfc_sbb(text), "UTF-8")).alias("digest"))


@query(f"WITH {_LINES}, m AS (SELECT doc_id, line_no, {_marked_sql('gt')} AS t FROM lines) SELECT doc_id, line_no, length_grapheme(t)::BIGINT AS n, array_to_string(list_transform(range(1, length_grapheme(t) + 1), lambda i: substring_grapheme(t, i, 1)), '|') AS parts FROM m")
def graphemes(spark, sf_dir):
    text = F.col("gt")
    for old, new in _MARKED:
        text = F.replace(text, F.lit(old), F.lit(new))
    rows = lines(spark, sf_dir).select("doc_id", "line_no", U.graphemes(text).alias("g"))
    return rows.select("doc_id", "line_no", F.size("g").cast("long").alias("n"), F.array_join("g", "|").alias("parts"))


@query(f"SELECT doc_id, len({_words_sql('text')})::BIGINT AS n, md5(array_to_string({_words_sql('text')}, '|')) AS digest FROM documents")
def words(spark, sf_dir):
    """Words of whole texts; a null text has neither a count nor a digest."""
    rows = table(spark, sf_dir, "documents").select("doc_id", U.words("text").alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.encode(F.array_join("w", "|"), "UTF-8")).alias("digest"))


# ---------------------------------------------------------------- scripts and alignments


@query(f"{_ALIGN_C} SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1)::BIGINT AS nth, op, i AS src_pos, j AS dest_pos FROM aligned WHERE op <> 'match'")
def editops(spark, sf_dir):
    rows = bench_pairs(spark, sf_dir).select("item_id", F.posexplode(D.editops("gt", "ocr")).alias("nth", "e"))
    return rows.select("item_id", F.col("nth").cast("long").alias("nth"), "e.op", F.col("e.src_pos").cast("long").alias("src_pos"), F.col("e.dest_pos").cast("long").alias("dest_pos"))


def _aligned(spark, sf_dir, level: str) -> DataFrame:
    return X.alignment_rows(bench_measured(spark, sf_dir), level, "item_id").withColumn("pos", F.col("pos").cast("long"))


@query(f"{_ALIGN_C} SELECT item_id, pos, gt, ocr FROM aligned")
def align_chars(spark, sf_dir):
    return _aligned(spark, sf_dir, "c_align")


@query(f"{_ALIGN_W} SELECT item_id, pos, gt, ocr FROM aligned")
def align_words(spark, sf_dir):
    return _aligned(spark, sf_dir, "w_align")


@query()
def align_lines(spark, sf_dir):
    """Sequences of whole lines: each document's lines against its lines after recognition, without the third ones."""
    kept = lambda n, x: (n % 3 != 2) | (x == "")
    both = documents_in_lines(spark, sf_dir).select("doc_id", F.col("l").alias("g"))
    both = both.withColumn("o", F.transform(F.filter("g", lambda x, n: kept(n, x)), lambda x: F.replace(x, F.lit("rn"), F.lit("m"))))
    return X.alignment_rows(both.withColumn("a", D.seq_align("g", "o")), "a", "doc_id")


@query(f"{_ALIGN_C} SELECT 'character_level' AS level, gt, ocr, count(*)::BIGINT AS n FROM aligned WHERE op <> 'match' GROUP BY gt, ocr")
def diff_counts_char(spark, sf_dir):
    return X.count_differences(bench_measured(spark, sf_dir), "c_align", level="character_level")


@query(f"{_ALIGN_W} SELECT 'word_level' AS level, gt, ocr, count(*)::BIGINT AS n FROM aligned WHERE op <> 'match' GROUP BY gt, ocr")
def diff_counts_word(spark, sf_dir):
    return X.count_differences(bench_measured(spark, sf_dir), "w_align", level="word_level")


@query()
def diff_counts_corpus(spark, sf_dir):
    """Counted differences of every line of the corpus on both levels."""
    return X.count_text_differences(lines(spark, sf_dir))


@query(f"""{_ALIGN_C},
spans AS (SELECT item_id, seq, start, start + length(t) AS stop FROM (
  SELECT item_id, t, seq, coalesce(sum(length(t) + 1) OVER (PARTITION BY item_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
    SELECT item_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS seq FROM (SELECT item_id, string_split(gt, chr(10)) AS l FROM lines)))),
placed AS (SELECT *, coalesce(sum(length(gt)) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM aligned)
SELECT a.item_id, a.pos, a.gt, a.ocr, CASE WHEN s.seq IS NOT NULL THEN 'line ' || s.seq END AS gt_segment_id
FROM placed a LEFT JOIN spans s ON s.item_id = a.item_id AND a.gt IS NOT NULL AND a.at >= s.start AND a.at < s.stop WHERE a.op <> 'match'""")
def segment_id_at_pos(spark, sf_dir):
    """Differing clusters with the line that they lie in."""
    found = _aligned(spark, sf_dir, "c_align")
    parts = bench_pairs(spark, sf_dir).select("item_id", F.posexplode(F.split("gt", "\n", -1)).alias("seq", "text")).withColumn("segment_id", F.concat(F.lit("line "), F.col("seq").cast("string")))
    return X.differences_in_segments(found, X.segment_spans(parts, "item_id"), "item_id")


# ---------------------------------------------------------------- roll-ups


def _per_doc(spark, sf_dir) -> DataFrame:
    return A.corpus_rates(measure(lines(spark, sf_dir), "gt", "ocr"), "doc_id", "source")


_PER_DOC = f"""{_LINES}, {_TOKENS},
per_doc AS (SELECT doc_id, source, {_rate_sql('sum(c_dist)', 'sum(n_characters)')} AS cer, {_rate_sql('sum(w_dist)', 'sum(n_words)')} AS wer FROM measured GROUP BY doc_id, source)"""


@query(f"WITH {_LINES}, {_TOKENS} SELECT source, {_rate_sql('sum(c_dist)', 'sum(n_characters)')} AS cer, sum(n_characters)::BIGINT AS n_characters, {_rate_sql('sum(w_dist)', 'sum(n_words)')} AS wer, sum(n_words)::BIGINT AS n_words FROM measured GROUP BY source")
def corpus_rates(spark, sf_dir):
    return A.corpus_rates(measure(lines(spark, sf_dir), "gt", "ocr"), "source")


@query(f"WITH {_LINES}, {_TOKENS} SELECT lang, source, {_rate_sql('sum(c_dist)', 'sum(n_characters)')} AS cer, sum(n_characters)::BIGINT AS n_characters, {_rate_sql('sum(w_dist)', 'sum(n_words)')} AS wer, sum(n_words)::BIGINT AS n_words, grouping(lang, source)::BIGINT AS depth FROM measured GROUP BY ROLLUP (lang, source)")
def corpus_rates_by_level(spark, sf_dir):
    return A.corpus_rates_by_level(measure(lines(spark, sf_dir), "gt", "ocr"), "lang", "source")


@query(f"WITH {_PER_DOC} SELECT count(*)::BIGINT AS num_reports, round(avg(cer), 6) AS cer_avg, round(avg(wer), 6) AS wer_avg, round(sum(cer), 6) AS cer_sum, round(sum(wer), 6) AS wer_sum FROM per_doc")
def macro_rates(spark, sf_dir):
    """Every document is a report."""
    return A.macro_rates(_per_doc(spark, sf_dir)).select("num_reports", *[F.round(c, 6).alias(c) for c in ("cer_avg", "wer_avg", "cer_sum", "wer_sum")])


def _bench_reports(spark, sf_dir) -> DataFrame:
    return bench_measured(spark, sf_dir).select("cer", "wer", F.struct(X.difference_map(F.col("c_align")).alias("character_level"), X.difference_map(F.col("w_align")).alias("word_level")).alias("differences"))


def _merged_sql() -> str:
    part = lambda a, level: f"SELECT '{level}' AS level, coalesce(gt, 'None') || ' :: ' || coalesce(ocr, 'None') AS key, count(*)::BIGINT AS n FROM ({a} SELECT gt, ocr FROM aligned WHERE op <> 'match') GROUP BY ALL"
    return f"SELECT level, key, sum(n)::BIGINT AS n FROM ({part(_ALIGN_C, 'character_level')} UNION ALL {part(_ALIGN_W, 'word_level')}) GROUP BY level, key"


@query(_merged_sql())
def merge_diff_maps(spark, sf_dir):
    return A.merge_difference_maps(_bench_reports(spark, sf_dir))


@query(f"SELECT level, count(*) FILTER (n >= 3)::BIGINT AS kept, count(*) FILTER (n < 3)::BIGINT AS omitted, coalesce(sum(n) FILTER (n >= 3), 0)::BIGINT AS occurrences FROM ({_merged_sql()}) GROUP BY level")
def threshold_diffs(spark, sf_dir):
    counts = A.merge_difference_maps(_bench_reports(spark, sf_dir))
    kept = A.over_threshold(counts, 3).groupBy("level").agg(F.count("*").alias("kept"), F.sum("n").alias("occurrences"))
    found = A.omitted(counts, 3).join(kept, "level", "left")
    return found.select("level", F.coalesce("kept", F.lit(0)).alias("kept"), "omitted", F.coalesce("occurrences", F.lit(0)).alias("occurrences"))


@query(f"""WITH {_BENCH}, r AS (SELECT {_rate_sql('c_dist', 'n_characters')} AS cer, {_rate_sql('w_dist', 'n_words')} AS wer FROM measured)
SELECT count(*)::BIGINT AS num_reports, round(avg(cer), 6) AS cer_avg, round(avg(wer), 6) AS wer_avg,
 (SELECT count(*) FROM ({_merged_sql()}) WHERE level = 'character_level')::BIGINT AS n_char_keys, (SELECT count(*) FROM ({_merged_sql()}) WHERE level = 'word_level')::BIGINT AS n_word_keys FROM r""")
def summary(spark, sf_dir):
    found = summary_of(_bench_reports(spark, sf_dir))
    return found.select("num_reports", F.round("cer_avg", 6).alias("cer_avg"), F.round("wer_avg", 6).alias("wer_avg"), F.size("character_level").cast("long").alias("n_char_keys"), F.size("word_level").cast("long").alias("n_word_keys"))


# ---------------------------------------------------------------- pairing


def _listing(spark, sf_dir, role: str, suffix: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter(F.col("role") == role)
    stem = F.format_string("%d/%d", F.col("conv_id"), F.floor(F.col("turn") / 2).cast("long"))
    return rows.select(F.concat(stem, F.lit(suffix)).alias("rel_path"), F.concat(stem, F.lit(".txt")).alias("file_name"), "text")


def _listing_sql(role: str, suffix: str) -> str:
    return f"(SELECT conv_id || '/' || turn // 2 || '{suffix}' AS rel_path, conv_id || '/' || turn // 2 || '.txt' AS file_name, conv_id || '/' || turn // 2 AS stem, text FROM conversations WHERE role = '{role}')"


_GT, _OCR = _listing_sql("user", ".gt.txt"), _listing_sql("assistant", ".ocr.txt")


@query(f"SELECT g.file_name, g.text AS gt_text, o.text AS ocr_text FROM {_GT} g JOIN {_OCR} o USING (file_name)")
def pair_by_name(spark, sf_dir):
    pairs = P.pair_by_name(_listing(spark, sf_dir, "user", ".gt.txt"), _listing(spark, sf_dir, "assistant", ".ocr.txt"))
    return pairs.select("file_name", F.col("gt.text").alias("gt_text"), F.col("ocr.text").alias("ocr_text"))


@query(f"SELECT g.stem, g.rel_path AS gt_path, o.rel_path AS ocr_path FROM {_GT} g LEFT JOIN {_OCR} o USING (stem)")
def pair_by_stem(spark, sf_dir):
    pairs = P.pair_by_suffix(_listing(spark, sf_dir, "user", ".gt.txt"), _listing(spark, sf_dir, "assistant", ".ocr.txt"), ".gt.txt", ".ocr.txt", strict=False)
    return pairs.select("stem", F.col("gt.rel_path").alias("gt_path"), F.col("ocr.rel_path").alias("ocr_path"))


@query(f"SELECT g.stem, g.rel_path AS gt_path, o.rel_path AS ocr_path FROM {_GT} g LEFT JOIN {_OCR} o USING (stem)")
def pair_by_detected_suffix(spark, sf_dir):
    """The same pairs without being told the suffixes."""
    pairs = P.pair_by_detected_suffix(_listing(spark, sf_dir, "user", ".gt.txt"), _listing(spark, sf_dir, "assistant", ".ocr.txt"), strict=False)
    return pairs.select("stem", F.col("gt.rel_path").alias("gt_path"), F.col("ocr.rel_path").alias("ocr_path"))


@query(f"SELECT file_name FROM {_GT} g WHERE file_name NOT IN (SELECT file_name FROM {_OCR} o)")
def pair_missing(spark, sf_dir):
    return P.unpaired(_listing(spark, sf_dir, "user", ".gt.txt"), _listing(spark, sf_dir, "assistant", ".ocr.txt")).select("file_name")


@query("""WITH r AS (SELECT role, min(reverse(p)) AS a, max(reverse(p)) AS b FROM (SELECT role, conv_id || '/' || turn || '.' || role || '.gt.txt' AS p FROM conversations) GROUP BY role)
SELECT role, reverse(a[1:coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i:i] <> b[i:i])), least(length(a), length(b)) + 1) - 1]) AS suffix FROM r""")
def common_suffix(spark, sf_dir):
    paths = table(spark, sf_dir, "conversations").select("role", F.format_string("%d/%d.%s.gt.txt", "conv_id", "turn", "role").alias("p"))
    return paths.groupBy("role").agg(S.common_suffix(F.col("p")).alias("suffix"))


# ---------------------------------------------------------------- page files


_PAGE_NS = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
_ALTO_NS = "http://www.loc.gov/standards/alto/ns-v3#"


def _extracted(docs: DataFrame, xml: Column, level: str = "region") -> DataFrame:
    files = docs.select("doc_id", F.encode(xml, "UTF-8").alias("content"))
    return R.segments(R.documents(files, level), "doc_id").withColumn("seq", F.col("seq").cast("long"))


def _each(build) -> Column:
    return F.array_join(F.transform("l", build), "")


def _number(n: Column) -> Column:
    return n.cast("string")


@query(f"WITH {_LINES} SELECT doc_id, line_no AS seq, 'l' || line_no AS segment_id, {_sbb_sql('gt')} AS text FROM lines")
def alto_lines(spark, sf_dir):
    """Documents as ALTO files, read back line by line."""
    string = lambda w: F.concat(F.lit('<String CONTENT="'), S.html_escape(w), F.lit('"/><SP/>'))
    line = lambda x, n: F.concat(F.lit('<TextLine ID="l'), _number(n), F.lit('">'), F.array_join(F.transform(F.split(x, " ", -1), string), ""), F.lit("</TextLine>"))
    xml = F.concat(F.lit(f'<alto xmlns="{_ALTO_NS}"><Layout><Page><PrintSpace><TextBlock>'), _each(line), F.lit("</TextBlock></PrintSpace></Page></Layout></alto>"))
    return _extracted(documents_in_lines(spark, sf_dir), xml).select("doc_id", "seq", "segment_id", "text")


@query(f"WITH {_LINES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::BIGINT AS seq, 'r' || line_no AS region_id, {_sbb_sql('gt')} AS text FROM lines WHERE gt <> ''")
def page_regions(spark, sf_dir):
    """Documents as PAGE files without a reading order: regions in document order, empty ones left out."""
    region = lambda x, n: F.concat(F.lit('<TextRegion id="r'), _number(n), F.lit('"><TextEquiv conf="0.4"><Unicode>wrong</Unicode></TextEquiv><TextEquiv index="0"><Unicode>'), S.html_escape(x), F.lit("</Unicode></TextEquiv></TextRegion>"))
    xml = F.concat(F.lit(f'<PcGts xmlns="{_PAGE_NS}"><Page>'), _each(region), F.lit("</Page></PcGts>"))
    return _extracted(documents_in_lines(spark, sf_dir), xml).select("doc_id", "seq", "region_id", "text")


@query(f"WITH {_LINES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) - 1)::BIGINT AS seq, 'l' || line_no AS segment_id, {_sbb_sql('gt')} AS text FROM lines WHERE gt <> ''")
def page_lines(spark, sf_dir):
    """Documents as prefixed PAGE files whose reading order is reversed and nested, read on the line level."""
    line = lambda x, n: F.concat(F.lit('<pc:TextRegion id="r'), _number(n), F.lit('"><pc:TextLine id="l'), _number(n), F.lit('"><pc:TextEquiv><pc:Unicode>'), S.html_escape(x), F.lit("</pc:Unicode></pc:TextEquiv></pc:TextLine></pc:TextRegion>"))
    ref = lambda x, n: F.concat(F.lit('<pc:RegionRefIndexed index="'), _number(F.lit(1_000_000) - n), F.lit('" regionRef="r'), _number(n), F.lit('"/>'))
    order = F.concat(F.lit('<pc:ReadingOrder><pc:UnorderedGroup id="u"><pc:RegionRef regionRef="image"/><pc:OrderedGroup id="o">'), _each(ref), F.lit("</pc:OrderedGroup></pc:UnorderedGroup></pc:ReadingOrder>"))
    xml = F.concat(F.lit(f'<pc:PcGts xmlns:pc="{_PAGE_NS}"><pc:Page>'), order, _each(line), F.lit("</pc:Page></pc:PcGts>"))
    return _extracted(documents_in_lines(spark, sf_dir), xml, "line").select("doc_id", "seq", "segment_id", "text")


@query(f"WITH {_LINES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY (line_no * 7919) % 104729) - 1)::BIGINT AS seq, 'r' || line_no AS region_id, gt AS text FROM lines WHERE gt <> ''")
def reading_order(spark, sf_dir):
    """The relational form: references in a scattered order, looked up in a table of regions."""
    rows = lines(spark, sf_dir).withColumn("region_id", F.concat(F.lit("r"), F.col("line_no").cast("string")))
    refs = rows.select("doc_id", ((F.col("line_no") * 7919) % 104729).alias("index"), F.col("region_id").alias("region_ref"))
    found = L.reading_order(refs, rows.select("doc_id", "region_id", F.col("line_no").alias("pos"), F.col("gt").alias("text")))
    return found.withColumn("seq", F.col("seq").cast("long"))


@query("""WITH e AS (SELECT conv_id, turn, text, CASE WHEN (conv_id + turn) % 4 = 1 AND conv_id % 2 = 0 THEN (turn * 5) % 7 END::DOUBLE AS idx, CASE WHEN conv_id % 3 > 0 THEN (turn * 3) % 4 END::DOUBLE AS conf FROM conversations),
k AS (SELECT conv_id, CASE WHEN count(idx) > 0 THEN arg_min(turn, (idx, turn)) FILTER (idx IS NOT NULL) WHEN count(conf) > 0 THEN arg_min(turn, (-conf, turn)) FILTER (conf IS NOT NULL) ELSE min(turn) END AS turn FROM e GROUP BY conv_id)
SELECT conv_id, turn AS pos, text FROM e JOIN k USING (conv_id, turn)""")
def textequiv_pick(spark, sf_dir):
    """Turns as text alternatives of their conversation."""
    c, t = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", t.alias("pos"), F.when(((c + t) % 4 == 1) & (c % 2 == 0), (t * 5) % 7).cast("double").alias("index"), F.when(c % 3 > 0, (t * 3) % 4).cast("double").alias("conf"), "text")
    return L.pick_equiv(rows, "conv_id").select("conv_id", "pos", "text")


@query("""SELECT conv_id, 'P' || turn AS page_id, 'GT/' || conv_id || '_' || turn || '.xml' AS gt_href, 'OCR/' || conv_id || '_' || turn || '.xml' AS ocr_href
FROM conversations WHERE role = 'assistant'""")
def mets_pairs(spark, sf_dir):
    """Conversations as METS workspaces: every turn has ground truth, the assistant's turns have recognised text."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    book = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    name = lambda x: x["turn"].cast("string")
    conv = F.col("conv_id").cast("string")

    def group(use: str, keep) -> Column:
        file = lambda x: F.concat(F.lit(f'<m:file ID="{use}_'), name(x), F.lit(f'" MIMETYPE="text/xml"><m:FLocat x:href="{use}/'), conv, F.lit("_"), name(x), F.lit('.xml"/></m:file>'))
        return F.concat(F.lit(f'<m:fileGrp USE="{use}">'), F.array_join(F.transform(F.filter("turns", keep), file), ""), F.lit("</m:fileGrp>"))

    page = lambda x: F.concat(F.lit('<m:div TYPE="page" ID="P'), name(x), F.lit('"><m:fptr FILEID="GT_'), name(x), F.lit('"/><m:fptr FILEID="OCR_'), name(x), F.lit('"/></m:div>'))
    xml = F.concat(
        F.lit('<m:mets xmlns:m="http://www.loc.gov/METS/" xmlns:x="http://www.w3.org/1999/xlink"><m:fileSec>'), group("GT", lambda x: F.lit(True)), group("OCR", lambda x: x["role"] == "assistant"),
        F.lit('</m:fileSec><m:structMap TYPE="PHYSICAL"><m:div TYPE="physSequence">'), F.array_join(F.transform("turns", page), ""), F.lit("</m:div></m:structMap></m:mets>"))
    files = R.mets_files(book.select(conv.alias("path"), F.encode(xml, "UTF-8").alias("content")))
    keep = files.withColumn("page_id", F.concat("path", F.lit("/"), F.col("page_id")))
    return P.pair_pages(keep, "GT", "OCR").select(
        F.split_part("page_id", F.lit("/"), F.lit(1)).cast("long").alias("conv_id"), F.split_part("page_id", F.lit("/"), F.lit(2)).alias("page_id"), F.col("gt.href").alias("gt_href"), F.col("ocr.href").alias("ocr_href"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::BIGINT AS line_no, trim(t, ' ' || chr(9)) AS text FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS n, len(l) AS m FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS l FROM documents)) WHERE NOT (t = '' AND n = m)")
def plain_lines(spark, sf_dir):
    """Whole documents as plain text files, line by line, on the JVM."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return R.plain_lines(files).select(F.col("path").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "text")


_STRIPPED = "regexp_replace(t, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"


@query(f"""WITH l AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS n, len(l) AS m FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::BIGINT AS line_no, 'line ' || (n - 1) AS segment_id, {_sbb_sql(_STRIPPED)} AS text FROM l WHERE NOT (t = '' AND n = m)""")
def plain_encoded(spark, sf_dir):
    """Whole documents as plain text files of differing encodings, with and without byte-order marks, read back by detection."""
    text, turn = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    mark = F.unhex(F.lit("EFBBBF"))
    utf8 = F.encode(text, "UTF-8")
    narrow = ~text.rlike("[^\\x{0}-\\x{7e}\\x{a0}-\\x{ff}]")
    content = F.when(turn == 1, F.concat(mark, utf8)).when((turn == 2) & narrow, F.encode(text, "ISO-8859-1")).when(turn == 3, F.encode(text, "UTF-16")).otherwise(utf8)
    files = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return R.segments(R.documents(files), "doc_id").select("doc_id", F.col("seq").cast("long").alias("line_no"), "segment_id", "text")


# ---------------------------------------------------------------- reports


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL WHEN (conv_id + turn) % 7 = 0 THEN NULL WHEN (conv_id + turn) % 11 = 0 THEN 'inf'::DOUBLE ELSE (conv_id % 100) / 128.0::DOUBLE END AS cer,
 CASE WHEN conv_id % 3 > 0 THEN (turn % 64) / 64.0::DOUBLE END AS wer FROM conversations)
SELECT conv_id, turn, cer, wer, cer IS NOT NULL AND wer IS NOT NULL AS valid, CASE WHEN turn % 2 = 0 THEN (turn + 1)::BIGINT END AS n_changed FROM r""")
def report_scan(spark, sf_dir):
    """Reports on disk, one of each turn: rates that are missing, null or infinite, and differences of some."""
    c, t = F.col("conv_id"), F.col("turn")
    number = lambda x: x.cast("double").cast("string")
    rate = F.when((c + t) % 7 == 0, F.lit("null")).when((c + t) % 11 == 0, F.lit("Infinity")).otherwise(number((c % 100) / 128))
    fields = F.array_compact(F.array(
        F.lit('"gt": "a"'), F.when(t % 5 != 4, F.concat(F.lit('"cer": '), rate)), F.when(c % 3 > 0, F.concat(F.lit('"wer": '), number((t % 64) / 64))),
        F.when(t % 2 == 0, F.concat(F.lit('"differences": {"character_level": {"a :: b": '), (t + 1).cast("string"), F.lit('}, "word_level": {}}')))))
    folder = scratch_path(spark, "reports")
    text = F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}"))
    write_rows(table(spark, sf_dir, "conversations").select(F.format_string(f"{folder}/%d_%d.json", c, t).alias("path"), text.alias("content")))
    place = F.split(F.regexp_extract("path", r"([0-9]+_[0-9]+)\.json$", 1), "_")
    found = R.read_reports(spark, folder).withColumn("valid", F.col("cer").isNotNull() & F.col("wer").isNotNull())
    return found.select(F.get(place, F.lit(0)).cast("long").alias("conv_id"), F.get(place, F.lit(1)).cast("long").alias("turn"), "cer", "wer", "valid", F.col("differences.character_level")["a :: b"].alias("n_changed"))


def _rendered(spark, sf_dir) -> DataFrame:
    segs = lambda c: F.transform(F.split(c, "\n", -1), lambda x, n: F.struct(F.concat(F.lit("line "), n.cast("string")).alias("segment_id"), x.alias("text")))
    rows = bench_measured(spark, sf_dir).select(
        F.col("item_id").alias("name"), F.format_string("gt/%d.txt", "item_id").alias("gt_path"), F.format_string("ocr/%d.txt", "item_id").alias("ocr_path"),
        segs("gt").alias("gt_segments"), segs("ocr").alias("ocr_segments"), "cer", "wer", "n_characters", "n_words", "c_align", "w_align")
    return render(rows, differences=True)


def _report_sql() -> str:
    """The JSON reports spelt in SQL: differences of a level in order of first occurrence."""
    quote = lambda text: f"to_json({text})::VARCHAR"

    def level(walk: str) -> str:
        keys = f"SELECT item_id, coalesce(gt, 'None') || ' :: ' || coalesce(ocr, 'None') AS key, count(*) AS n, min(pos) AS first_pos FROM ({walk} SELECT item_id, pos, gt, ocr FROM aligned WHERE op <> 'match') GROUP BY ALL"
        return f"SELECT item_id, string_agg({quote('key')} || ':' || n, ',' ORDER BY first_pos) AS m FROM ({keys}) GROUP BY item_id"

    return f"""WITH {_BENCH}, r AS (SELECT item_id, n_characters, n_words, {_rate_sql('c_dist', 'n_characters')} AS cer, {_rate_sql('w_dist', 'n_words')} AS wer FROM measured)
SELECT r.item_id, '{{"gt": "gt/' || r.item_id || '.txt", "ocr": "ocr/' || r.item_id || '.txt", "cer": ' || cer || ', "wer": ' || wer || ', "differences": {{"character_level":{{' || coalesce(c.m, '')
 || '}},"word_level":{{' || coalesce(w.m, '') || '}}}}, "n_characters": ' || n_characters || ', "n_words": ' || n_words || '}}' AS json
FROM r LEFT JOIN ({level(_ALIGN_C)}) c ON c.item_id = r.item_id LEFT JOIN ({level(_ALIGN_W)}) w ON w.item_id = r.item_id"""


@query(_report_sql())
def report_json(spark, sf_dir):
    return _rendered(spark, sf_dir).select(F.col("name").alias("item_id"), "json")


@query()
def report_html(spark, sf_dir):
    return _rendered(spark, sf_dir).select(F.col("name").alias("item_id"), "html")


# ---------------------------------------------------------------- scripts, summaries and reports of every document


def lines_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(lines(spark, sf_dir), "gt", "ocr", alignments=True)


def documents_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its rates, its lines as segments and the alignments of its lines in a row."""
    rows = lines_measured(spark, sf_dir)
    rates = A.corpus_rates(rows, "doc_id")
    inline = F.array_sort(F.collect_list(F.struct("line_no", "gt", "ocr", "c_align", "w_align")))
    seg = lambda c: F.transform("l", lambda x: F.struct(F.concat(F.lit("line "), x["line_no"].cast("string")).alias("segment_id"), x[c].alias("text")))
    flat = lambda c: F.flatten(F.transform("l", lambda x: x[c]))
    whole = rows.groupBy("doc_id").agg(inline.alias("l")).select(
        "doc_id", seg("gt").alias("gt_segments"), seg("ocr").alias("ocr_segments"), flat("c_align").alias("c_align"), flat("w_align").alias("w_align"))
    return whole.join(rates, "doc_id")


@query()
def editops_documents(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", "line_no", F.posexplode(D.editops("gt", "ocr")).alias("nth", "e"))
    return rows.select("doc_id", "line_no", F.col("nth").cast("long").alias("nth"), "e.op", F.col("e.src_pos").cast("long").alias("src_pos"), F.col("e.dest_pos").cast("long").alias("dest_pos"))


@query()
def align_chars_documents(spark, sf_dir):
    return X.alignment_rows(lines_measured(spark, sf_dir), "c_align", "doc_id", "line_no").withColumn("pos", F.col("pos").cast("long"))


@query()
def align_words_documents(spark, sf_dir):
    return X.alignment_rows(lines_measured(spark, sf_dir), "w_align", "doc_id", "line_no").withColumn("pos", F.col("pos").cast("long"))


def _document_reports(spark, sf_dir) -> DataFrame:
    return documents_measured(spark, sf_dir).select("cer", "wer", F.struct(X.difference_map(F.col("c_align")).alias("character_level"), X.difference_map(F.col("w_align")).alias("word_level")).alias("differences"))


@query()
def merge_diff_maps_documents(spark, sf_dir):
    return A.merge_difference_maps(_document_reports(spark, sf_dir))


@query()
def summary_documents(spark, sf_dir):
    return summary_of(_document_reports(spark, sf_dir))


@query()
def threshold_diffs_documents(spark, sf_dir):
    counts = X.count_text_differences(lines(spark, sf_dir))
    kept = A.over_threshold(counts, 3).groupBy("level").agg(F.count("*").alias("kept"), F.sum("n").alias("occurrences"))
    found = A.omitted(counts, 3).join(kept, "level", "left")
    return found.select("level", F.coalesce("kept", F.lit(0)).alias("kept"), "omitted", F.coalesce("occurrences", F.lit(0)).alias("occurrences"))


@query()
def segment_id_at_pos_documents(spark, sf_dir):
    """Differing clusters of every line with the word-group segment, four words each, that they lie in."""
    found = X.alignment_rows(lines_measured(spark, sf_dir), "c_align", "doc_id", "line_no").withColumn("pos", F.col("pos").cast("long"))
    four = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 4).cast("int")), lambda k: F.array_join(F.slice("w", k * 4 + 1, F.lit(4)), " "))
    parts = lines(spark, sf_dir).select("doc_id", "line_no", F.split("gt", " ", -1).alias("w")).select("doc_id", "line_no", F.posexplode(four).alias("seq", "text"))
    parts = parts.withColumn("segment_id", F.concat(F.lit("group "), F.col("seq").cast("string")))
    return X.differences_in_segments(found, X.segment_spans(parts, "doc_id", "line_no"), "doc_id", "line_no")


def _documents_rendered(spark, sf_dir) -> DataFrame:
    rows = documents_measured(spark, sf_dir).select(
        F.col("doc_id").alias("name"), F.format_string("gt/%d.txt", "doc_id").alias("gt_path"), F.format_string("ocr/%d.txt", "doc_id").alias("ocr_path"),
        "gt_segments", "ocr_segments", "cer", "wer", "n_characters", "n_words", "c_align", "w_align")
    return render(rows, differences=True)


@query()
def report_json_documents(spark, sf_dir):
    return _documents_rendered(spark, sf_dir).select(F.col("name").alias("doc_id"), "json")


@query()
def report_html_documents(spark, sf_dir):
    return _documents_rendered(spark, sf_dir).select(F.col("name").alias("doc_id"), "html")
