r"""Quality rules from cross-document line frequency, native DataFrame operations only.

Lines (split at \n) are normalised (lower case, digits to 0, white space collapsed) and hashed.  For each host and line hash
the distinct documents are counted; a line of any length above its host's limit is removed from that host's documents, and a
document that loses more than ``DEPLETED`` of its words is rejected.  The limit is ``SHARE`` of the host's rows, but
``MIN_DOCUMENTS`` at least and ``MOST_DOCUMENTS`` at most, so that it does not rise on with a large host.

Which documents count as distinct: copies and near copies of one document must not make their own lines look like boilerplate, so
they count once.  Documents of a host with the same lines are copies.  Only documents that the counts of these would
deplete can be near copies of many others, so only they are compared: those whose sets of ``NEAR_WORDS``-word windows have a Jaccard
similarity of ``NEAR`` or more are near copies, and a connected group of them is one document in the final counts.  Candidates agree
in one of ``BANDS`` bands of their smallest window hashes; the similarity is taken from all of them.  Boilerplate stands in documents that
differ; pages of the same lines only are copies of each other.

The base rules look at one text alone: fewer than ``MIN_WORDS`` words, or more than 30 % of the words inside 8-word windows that
occur twice in the text.

Edge cases: null and empty texts have no words and fail; a null host is a host of its own; rows are judged one by one, so
repeated rows get the same verdict each; an empty table gives an empty result; other columns are ignored.  Only hashes and numbers are
shuffled, never texts; the counts are pre-aggregated, and joins on a hot host's lines read written tables on both sides, so they can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, table
from .graph import components

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
MIN_DOCUMENTS, MOST_DOCUMENTS, SHARE, DEPLETED = 10, 1000, 0.005, 0.5
NEAR_WORDS, NEAR, BANDS, ROWS = 5, 0.8, 8, 3
_BLANKS = " \t\n\x0b\f\r"


def line_hash(line: Column) -> Column:
    """16-byte hash of a normalised line."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACE, " ")
    return F.unhex(F.md5(F.btrim(plain, F.lit(" ")).cast("binary")))


def _tokens(text: Column) -> Column:
    inner = F.btrim(text, F.lit(_BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE, -1))


def _windows(w: str, k: int) -> Column:
    """Hash of each run of ``k`` of the words in column ``w``."""
    n = F.size(w)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(F.col(w), i, k)))).otherwise(F.array().cast("array<bigint>"))


def base_features(rows: DataFrame) -> DataFrame:
    """Adds words' counts and the lines' hashes to rows with a column ``text``; drops the text."""
    keep = [c for c in rows.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    split = rows.select(*keep, text.alias("text"), _tokens(text).alias("w"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    counted = split.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(line_hash(x).alias("hash"), F.size(_tokens(x)).alias("words"))).alias("lines"),
        _windows("w", WINDOW).alias("h"),
    )
    # Windows that occur twice: neighbours with equal hashes once sorted with their places.
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    placed = counted.withColumn("s", F.when(repeats, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h")
    s = F.col("s")
    same = lambda x, j: (F.get(s, j)["h"] == x["h"])
    twice = F.filter(s, lambda x, j: F.coalesce((j > 0) & same(x, F.greatest(j - 1, F.lit(0))), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
    places = placed.withColumn("p", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("s")
    covered = F.transform("p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), j + 1) - x, F.lit(WINDOW))))
    return places.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("p")


def near_classes(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the rows of ``documents`` (node, host, text) that have near copies in their host."""
    words = documents.select("node", "host", _tokens(F.col("text")).alias("w"))
    sets = scratch.save(words.select("node", "host", F.array_distinct(F.sort_array(_windows("w", NEAR_WORDS))).alias("windows")).dropDuplicates(["node"]), "windows")
    members = lambda b: F.slice(F.filter("windows", lambda x: F.shiftright(x, 3).bitwiseAND(F.lit(BANDS - 1)) == b), 1, ROWS)
    bands = F.array(*[F.when(F.size(members(b)) > 0, F.xxhash64("host", F.lit(b), members(b))) for b in range(BANDS)])
    keys = scratch.save(sets.select("node", F.explode(F.array_compact(bands)).alias("key")), "keys")
    least = scratch.save(keys.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), "a"), "least")
    pairs = scratch.save(keys.join(least, F.col("key") == F.col("k")).where("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    side = lambda x: sets.select(F.col("node").alias(f"node_{x}"), F.col("windows").alias(f"windows_{x}"))
    both = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
    same = F.size(F.array_intersect("windows_a", "windows_b"))
    alike = 100 * same >= int(100 * NEAR) * (F.size("windows_a") + F.size("windows_b") - same)
    links = scratch.save(both.where(alike).select("a", "b"), "links")
    scratch.drop("windows", "keys", "least", "pairs")
    return components(links, scratch)


def line_limit(rows: Column) -> Column:
    """The distinct documents in which a line may stand, given its host's rows."""
    return F.least(F.greatest(F.lit(float(MIN_DOCUMENTS)), SHARE * rows), F.lit(float(MOST_DOCUMENTS)))


def judge(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, fingerprint of (text, host), the base counts, base_failed, removed (line hashes), removed_words, kept."""
    host = F.coalesce(docs[host_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col], host).alias("fingerprint"), host.alias("host"), docs[text_col].alias("text"))
    features = scratch.save(base_features(rows).withColumn("row", F.monotonically_increasing_id()), "features")

    # Lines with many rows, then those with many documents once copies count once.
    document = F.xxhash64("host", F.transform("lines", lambda x: x["hash"]))
    lines = features.select("row", "host", document.alias("document"), F.explode("lines").alias("line")).select("row", "host", "document", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    limits = features.groupBy("host").agg(line_limit(F.count(F.lit(1))).alias("most"))
    above = lambda counted: counted.where(F.col("n") > MIN_DOCUMENTS).join(limits, "host").where("n > most").select(F.col("host").alias("h"), F.col("hash").alias("x"))
    count = F.count(F.lit(1)).alias("n")
    rows_above = scratch.save(above(lines.groupBy("host", "hash").agg(count)), "rows-above")
    among = lambda part, chosen: part.join(chosen, (F.col("host") == F.col("h")) & (F.col("hash") == F.col("x"))).drop("h", "x")
    carried = scratch.save(among(lines, rows_above), "carried")
    copies_once = above(carried.select("host", "hash", "document").distinct().groupBy("host", "hash").agg(count))
    carried = scratch.save(among(carried, scratch.save(copies_once, "common")), "common-lines")
    scratch.drop("carried", "rows-above", "common")

    # Documents that these counts would deplete: near copies among them count once, too.
    lost = carried.groupBy("row", "document").agg(F.sum("words").alias("lost")).withColumnRenamed("row", "r")
    depleted = features.join(lost, F.col("row") == F.col("r")).where(F.col("lost") > DEPLETED * F.col("n_words")).groupBy("document").agg(F.min_by(F.struct("id", "fingerprint"), "row").alias("one"))
    depleted = scratch.save(depleted.select(F.col("document").alias("node"), F.col("one.id").alias("node_id"), F.col("one.fingerprint").alias("node_fingerprint")), "depleted")
    texts = rows.join(depleted, F.col("id").eqNullSafe(F.col("node_id")) & (F.col("fingerprint") == F.col("node_fingerprint"))).select("node", "host", "text")
    classes = scratch.save(near_classes(texts, scratch), "classes")
    held = scratch.save(carried.select("host", "hash", "document").distinct(), "held")
    classed = held.join(classes, F.col("document") == F.col("node"), "left").select("host", "hash", F.coalesce("component", "document").alias("class")).distinct()
    frequent = scratch.save(above(classed.groupBy("host", "hash").agg(count)), "frequent")
    gone = among(carried, frequent).groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_set("hash").alias("removed"))
    gone = scratch.save(gone.withColumnRenamed("row", "r"), "gone")
    scratch.clear("features", "gone")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    removed_words = F.coalesce("removed_words", F.lit(0))
    return features.join(gone, F.col("row") == F.col("r"), "left").select(
        "id", "fingerprint", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.coalesce("removed", F.array().cast("array<binary>")).alias("removed"), removed_words.cast("long").alias("removed_words"),
        (~failed & (removed_words <= DEPLETED * F.col("n_words"))).alias("kept"),
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents that pass, all columns, without the removed lines."""
    scratch = Scratch(docs.sparkSession, "quality")
    verdicts = judge(docs, scratch, id_col, text_col, host_col).where("kept").select(F.col("id").alias("__id"), F.col("fingerprint").alias("__fingerprint"), F.col("removed").alias("__removed")).distinct()
    verdicts = scratch.save(verdicts, "kept")
    scratch.clear("kept")
    fingerprint = F.xxhash64(docs[text_col], F.coalesce(docs[host_col].cast("string"), F.lit("")))
    joined = docs.join(verdicts, docs[id_col].eqNullSafe(F.col("__id")) & (fingerprint == F.col("__fingerprint")))
    left = F.array_join(F.filter(F.split(docs[text_col], "\n", -1), lambda x: ~F.array_contains(F.col("__removed"), line_hash(x))), "\n")
    text = F.when(F.size("__removed") == 0, docs[text_col]).otherwise(left)
    columns = [text.alias(c) if c == text_col else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == chars_col else docs[c] for c in docs.columns]
    return joined.select(*columns)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = judge(table(spark, sf_dir, "documents"), Scratch(spark, "quality"))
    return verdicts.select(F.col("id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


#: Near copies by their exact similarity; it assumes that each doc_id stands once.
OP1_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), d AS (
  SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), limits AS (
  SELECT host, least(greatest(10, 0.005::DOUBLE * count(*)), 1000) AS most FROM t GROUP BY host
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM dup) GROUP BY doc_id
), l AS (
  SELECT doc_id, host, place, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS h,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, host, unnest(lines) AS x, unnest(range(len(lines))) AS place FROM d)
), o AS (
  SELECT doc_id, host || md5(string_agg(h, chr(10) ORDER BY place)) AS document FROM l GROUP BY doc_id, host
), c AS (
  SELECT l.host, h FROM l JOIN o USING (doc_id) JOIN limits USING (host) GROUP BY l.host, h, most HAVING count(DISTINCT document) > most
), lost AS (
  SELECT doc_id, sum(words) AS n FROM l JOIN c USING (host, h) GROUP BY doc_id
), depleted AS (
  SELECT document, d.host, arg_min(w, d.doc_id) AS w FROM d JOIN o USING (doc_id) JOIN lost USING (doc_id) WHERE lost.n > 0.5::DOUBLE * len(w) GROUP BY document, d.host
), s AS (
  SELECT DISTINCT document, host, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT document, host, w, unnest(range(1, len(w) - 3)) AS i FROM depleted)
), sizes AS (
  SELECT document, count(*) AS n FROM s GROUP BY document
), near AS (
  SELECT p.a, p.b FROM (
    SELECT x.document AS a, y.document AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.host = y.host AND x.document <> y.document GROUP BY ALL
  ) p JOIN sizes na ON na.document = p.a JOIN sizes nb ON nb.document = p.b WHERE 100 * m >= 80 * (na.n + nb.n - m)
), reach AS (
  SELECT document AS s, document AS e FROM depleted UNION SELECT reach.s, near.b FROM reach JOIN near ON reach.e = near.a
), classes AS (
  SELECT s AS document, min(e) AS class FROM reach GROUP BY s
), f AS (
  SELECT l.host, h FROM l JOIN c USING (host, h) JOIN o USING (doc_id) LEFT JOIN classes USING (document) JOIN limits USING (host)
  GROUP BY l.host, h, most HAVING count(DISTINCT coalesce(class, document)) > most
), r AS (
  SELECT doc_id, sum(words) AS removed_words FROM l JOIN f USING (host, h) GROUP BY doc_id
), x AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND removed_words <= 0.5::DOUBLE * n_words AS kept
FROM x
"""
