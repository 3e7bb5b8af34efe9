"""Texts cut off by a field limit or a broken transfer, found from word trigrams in pure SQL.

The corpus says where sentences may end: for every word trigram (within one sentence, padded with ``^``) it is
counted how often the sentence goes on after it, how often it ends a sentence, and in how many different texts
it is the bare end. The final trigram of a text is judged by the share of its occurrences that are terminal, with
back-off to its last two words, its last word, and all words: a trigram that is frequent inside texts but almost never
terminal was cut. A last word that elsewhere is longer after the same two words counts as going on, which shows a cut
within a word; so do all its unseen forms, by the back-off.

What is terminal depends on how the text ends:

* ``bare`` (no stop): the bare ends of other texts, such as set closing phrases and telephone numbers;
* ``dots``: these and sentence ends, as dots may close a complete text;
* ``mark`` (``[more]`` and the like): as the text before the mark ends, bare or with a stop;
* ``stop``: sentence ends, against the same word and stop within a sentence (``No. 5``).

Digits count as ``9``, so numbers of one length are one word. All counts cover all documents, copies of a text count
once where ends are counted. The aggregation combines map-side over trigrams as they are written; patterns run over
distinct trigrams only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pressmill.session import durable

#: Endings that say a text was cut. Dots may also close a complete text, so they are weighed like bare ends.
CUT_MARK = r"\s*(\[[\p{L} .]{1,14}\]|\([\p{L} .]{1,14}\)|>>+|»|→|-->)$"
DOTS = r"\s*(\.{2,}|…)$"
STOP = r"[.!?।]+[\"')\]”’]*$"

# A paragraph end is a word of its own.
WORDS_SQL = r"""
SELECT split(trim(BOTH ' \n\r\t' FROM regexp_replace(translate(text, '012345678', '999999999'), '\\n\\s*\\n', ' \u0001 ')), '[ \n\r\t]+') AS w
FROM {docs} WHERE text IS NOT NULL
"""

# (a, b, c) with what follows: '' nothing, a paragraph end, '>' a word that begins no sentence, '<' any other.
WRITTEN_SQL = r"""
SELECT a, b, c, CASE WHEN d IS NULL THEN '' WHEN d = '\u0001' THEN d WHEN d RLIKE '^[a-z9]' THEN '>' ELSE '<' END AS follows, count(*) AS n
FROM (
  SELECT inline(arrays_zip(concat(array('^', '^'), w), concat(array('^'), w), w, slice(w, 2, size(w)))) AS (a, b, c, d)
  FROM {words}
) WHERE c IS NOT NULL AND c <> '' AND c <> '\u0001' GROUP BY ALL
"""

# Words before a sentence end become pads, so that no trigram spans two sentences.
TRIGRAMS_SQL = r"""
SELECT if(b = '^' OR edge_a, '^', a) AS a, b, regexp_replace(c, :stop, '') AS c,
  sum(if(NOT stops AND follows <> '\u0001' AND follows <> '', n, 0)) AS n_on,
  sum(if(stops AND follows = '>', n, 0)) AS n_inner,
  sum(if(stops AND follows <> '>' OR follows = '\u0001', n, 0)) AS n_stop
FROM (
  SELECT a, if(b = '\u0001' OR b RLIKE :stop, '^', b) AS b, a = '\u0001' OR a RLIKE :stop AS edge_a, c, c RLIKE :stop AS stops, follows, n
  FROM {written}
) GROUP BY ALL
"""

# The last 20 words hold every ending pattern (19 characters at most, so no more words) and the final trigram. Each step is
# generated, not projected: projections are merged, and an expression used twice would be evaluated twice.
FINALS_SQL = r"""
SELECT doc_id, source, h, ending, stopped, b, if(b = '^' OR a = '\u0001' OR a RLIKE :stop, '^', a) AS a, c
FROM {docs}
  LATERAL VIEW inline(array(struct(xxhash64(text), substring_index(text, ' ', -64)))) AS h, near
  LATERAL VIEW inline(array(struct(split(trim(BOTH ' \n\r\t' FROM regexp_replace(translate(
    if(regexp_count(near, '\\S+') > 24, near, text), '012345678', '999999999'), '\\n\\s*\\n', ' \u0001 ')), '[ \n\r\t]+')))) AS words
  LATERAL VIEW inline(array(struct(array_join(slice(words, greatest(size(words) - 21, 1), 22), ' ')))) AS tail
  LATERAL VIEW inline(array(struct(regexp_replace(tail, :cut_mark, '')))) AS rest
  LATERAL VIEW inline(array(struct(regexp_replace(rest, :dots, '')))) AS body
  LATERAL VIEW inline(array(struct(
    CASE WHEN tail <> rest THEN 'mark' WHEN rest <> body THEN 'dots' WHEN body RLIKE :stop THEN 'stop' ELSE 'bare' END, rest = body AND body RLIKE :stop,
    concat(array('^', '^'), split(body, ' '))))) AS ending, stopped, w
  LATERAL VIEW inline(array(struct(w[size(w) - 3], if(w[size(w) - 2] = '\u0001' OR w[size(w) - 2] RLIKE :stop, '^', w[size(w) - 2]), regexp_replace(w[size(w) - 1], :stop, '')))) AS a, b, c
WHERE body <> ''
"""

# Prefixes of a last word turn "is longer elsewhere" into an equality, linear in distinct trigrams. The pair of
# a sentence opening (^ ^) goes with a vocabulary of words, so pairs meet in sixteen parts.
JUDGED_SQL = r"""
WITH ends AS (SELECT DISTINCT h, a, b, c FROM {finals} WHERE NOT stopped),
 e3 AS (SELECT a, b, c, count(*) AS n FROM ends GROUP BY ALL),
 e2 AS (SELECT b, c, sum(n) AS n FROM e3 GROUP BY ALL),
 e1 AS (SELECT c, sum(n) AS n FROM e2 GROUP BY ALL),
 keys AS (SELECT DISTINCT a, b, c FROM {finals}),
 near AS (
  SELECT t.a, t.b, t.c, n_on, n_inner, n_stop FROM (SELECT *, pmod(xxhash64(c), 16) AS part FROM {trigrams}) t
  LEFT SEMI JOIN (SELECT a, b, explode(sequence(0, 15)) AS part FROM (SELECT DISTINCT a, b FROM keys)) k ON t.a = k.a AND t.b = k.b AND t.part = k.part
 ),
 t3 AS (
  SELECT a, b, c, sum(if(own, n_on, 0)) AS n_on, sum(if(own, n_inner, 0)) AS n_inner, sum(if(own, n_stop, 0)) AS n_stop, sum(if(own, 0, n_on + n_inner + n_stop)) AS n_longer
  FROM (SELECT a, b, substr(c, 1, n) AS c, n = length(c) AS own, n_on, n_inner, n_stop FROM (SELECT *, explode(sequence(1, length(c))) AS n FROM near WHERE c <> '')) GROUP BY ALL
 ),
 g2 AS (SELECT b, c, sum(n_on) AS n_on, sum(n_inner) AS n_inner, sum(n_stop) AS n_stop FROM {trigrams} GROUP BY ALL),
 g1 AS (SELECT c, sum(n_on) AS n_on, sum(n_inner) AS n_inner, sum(n_stop) AS n_stop FROM g2 GROUP BY ALL),
 t2 AS (
  SELECT b, c, sum(if(own, n_on, 0)) AS n_on, sum(if(own, n_inner, 0)) AS n_inner, sum(if(own, n_stop, 0)) AS n_stop, sum(if(own, 0, n_on + n_inner + n_stop)) AS n_longer
  FROM (SELECT b, substr(c, 1, n) AS c, n = length(c) AS own, n_on, n_inner, n_stop FROM (SELECT *, explode(sequence(1, length(c))) AS n FROM g2 LEFT SEMI JOIN keys USING (b) WHERE c <> '')) GROUP BY ALL
 ),
 t1 AS (
  SELECT c, sum(if(own, n_on, 0)) AS n_on, sum(if(own, n_inner, 0)) AS n_inner, sum(if(own, n_stop, 0)) AS n_stop, sum(if(own, 0, n_on + n_inner + n_stop)) AS n_longer
  FROM (SELECT substr(c, 1, n) AS c, n = length(c) AS own, n_on, n_inner, n_stop FROM (SELECT *, explode(sequence(1, length(c))) AS n FROM g1 WHERE c <> '')) GROUP BY ALL
 ),
 t0 AS (SELECT coalesce(sum(n_on), 0) AS n_on, coalesce(sum(n_inner), 0) AS n_inner, coalesce(sum(n_stop), 0) AS n_stop FROM g1),
 known AS (
  SELECT k.a, k.b, k.c,
    coalesce(t3.n_on, 0) AS on3, coalesce(t3.n_inner, 0) AS in3, coalesce(t3.n_stop, 0) AS st3, coalesce(t3.n_longer, 0) AS lo3, coalesce(e3.n, 0) AS en3,
    coalesce(t2.n_on, 0) AS on2, coalesce(t2.n_inner, 0) AS in2, coalesce(t2.n_stop, 0) AS st2, coalesce(t2.n_longer, 0) AS lo2, coalesce(e2.n, 0) AS en2,
    coalesce(t1.n_on, 0) AS on1, coalesce(t1.n_inner, 0) AS in1, coalesce(t1.n_stop, 0) AS st1, coalesce(t1.n_longer, 0) AS lo1, coalesce(e1.n, 0) AS en1,
    (SELECT n_on FROM t0) AS on0, (SELECT n_inner FROM t0) AS in0, (SELECT n_stop FROM t0) AS st0, (SELECT coalesce(sum(n), 0) FROM e1) AS en0
  FROM keys k LEFT JOIN t3 ON t3.a = k.a AND t3.b = k.b AND t3.c = k.c LEFT JOIN t2 ON t2.b = k.b AND t2.c = k.c LEFT JOIN t1 ON t1.c = k.c
    LEFT JOIN e3 ON e3.a = k.a AND e3.b = k.b AND e3.c = k.c LEFT JOIN e2 ON e2.b = k.b AND e2.c = k.c LEFT JOIN e1 ON e1.c = k.c
 ),
 counted AS (
  SELECT f.doc_id, f.source, f.ending, f.stopped,
    CASE WHEN stopped THEN array(st3, st2, st1, st0) WHEN ending = 'dots' THEN array(st3 + en3 - 1, st2 + en2 - 1, st1 + en1 - 1, st0 + en0 - 1)
      ELSE array(en3 - 1, en2 - 1, en1 - 1, en0 - 1) END AS ends,
    CASE WHEN stopped THEN array(in3, in2, in1, in0) WHEN ending = 'dots' THEN array(on3 + in3 + lo3, on2 + in2 + lo2, on1 + in1 + lo1, on0 + in0)
      ELSE array(on3 + in3 + st3 + lo3, on2 + in2 + st2 + lo2, on1 + in1 + st1 + lo1, on0 + in0 + st0) END AS inner
  FROM {finals} f JOIN known k ON f.a = k.a AND f.b = k.b AND f.c = k.c
 )
SELECT doc_id, source, ending,
  (ends[0] + (ends[1] + (ends[2] + :weight * coalesce(ends[3] / nullif(ends[3] + inner[3], 0), if(stopped, 1, 0))) / (ends[2] + inner[2] + :weight) * :weight) / (ends[1] + inner[1] + :weight) * :weight)
    / (ends[0] + inner[0] + :weight) AS terminal,
  if(stopped, :full, if(ending = 'dots', :dotted, :bare)) AS least
FROM counted
"""


def judged(docs: DataFrame, bare: float = 0.5, dotted: float = 0.27, full: float = 0.15, weight: float = 0.5) -> DataFrame:
    """(doc_id, source, ending, terminal, cut) for every row of ``docs(doc_id, source, text)``.

    ``terminal`` is the smoothed share of the final trigram's occurrences that are terminal, each level of back-off having the
    ``weight`` of that many occurrences; a text is cut if it is below ``bare``, ``dotted`` or, after a stop, ``full``.
    Null, empty and white-space texts are complete ('empty', terminal 1). Texts of one or two words are padded.
    Repeated doc_ids stay repeated. Extra columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "source", "text")
    written = spark.sql(WRITTEN_SQL, words=spark.sql(WORDS_SQL, docs=texts))
    # Both are read several times below; the tokens they come from are far larger than they are.
    trigrams = durable(spark.sql(TRIGRAMS_SQL, args={"stop": STOP}, written=written))
    finals = durable(spark.sql(FINALS_SQL, args={"stop": STOP, "dots": DOTS, "cut_mark": CUT_MARK}, docs=texts.where("text NOT RLIKE '^\\\\s*$'")))
    known = spark.sql(JUDGED_SQL, args={"weight": weight, "full": full, "dotted": dotted, "bare": bare}, finals=finals, trigrams=trigrams)
    empty = texts.where("text IS NULL OR text RLIKE '^\\\\s*$'").selectExpr("doc_id", "source", "'empty' AS ending", "1.0D AS terminal", "false AS cut")
    return known.selectExpr("doc_id", "source", "ending", "terminal", "terminal < least AS cut").unionByName(empty)


def source_rates(judgement: DataFrame) -> DataFrame:
    """How often each source truncates: documents, cut documents and their share."""
    return judgement.groupBy("source").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "n_docs").join(
        judgement.where("cut").groupBy("source").count().withColumnRenamed("count", "n_cut"), "source", "left"
    ).selectExpr("source", "n_docs", "coalesce(n_cut, 0) AS n_cut", "round(coalesce(n_cut, 0) / n_docs, 6) AS cut_share")
