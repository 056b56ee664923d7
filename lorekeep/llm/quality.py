"""Quality rules by distribution divergence.

A first pass counts, per labelled language and over all documents, how characters fall into classes and how
often each word stands; the classes and the ``COMMON`` most frequent words (with one bin for all other words)
are the references of that language. A second pass makes the same two histograms of each text and takes their
Jensen-Shannon distances (base 2, square root) to the reference of the text's language. A text is kept if it
passes the base rules and neither distance is too large.

Short texts scatter: the classes are compared from ``CLASS_LEAST`` characters on and the words from
``WORD_LEAST`` words on; below that the distance is null and passes. A text of n words drawn from the reference
itself has a squared distance of about bins / (8 n ln 2), which is allowed on top of ``WORD_FAR``. A language has references if it holds at
least one thousandth of the characters of all labelled documents, so there are at most 1,000 of them. Texts of
any other label, or of none, are held against all references and take the nearest, and their words are only
judged if they have no label at all. Without any reference both distances are null.

Words are runs of other characters than blanks. For the histogram A-Z are lower-cased and ASCII marks at both
ends go. A null or empty text has no words and fails the base rules; long texts are read whole, in arrays of a
few numbers per word. Ties between words go to the one that sorts first, those between references to the label
that sorts first. Repeated rows give repeated result rows and count as often as they stand there; an empty
table gives no rows. Other columns are never looked at, whatever their names; ``good_documents`` returns them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.common import documents, stored, text_chunks
from lorekeep.llm.words import flat_bytes

COMMON = 50
SHARE = 0.001
CLASS_LEAST = 100
WORD_LEAST = 100
CLASS_FAR = 0.3
WORD_FAR = 0.25
BASE_WORDS = 50
DIGITS = 6
CLASSES = ("lower", "upper", "digit", "blank", "stop", "mark", "sign", "control", "foreign")
STOPS = ".,;:!?'\"()-"
MARKS = "#*$%&|<>"
TRIMMED = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
REFERENCE_BYTES = 4 << 20
SALTS = 32


def _class_table() -> np.ndarray:
    """The class of each byte; the bytes that continue a character have the number after the last class."""
    table = np.full(256, CLASSES.index("sign"), np.uint8)
    table[:33] = table[127] = CLASSES.index("control")
    table[[32, *range(9, 14)]] = CLASSES.index("blank")
    for name, chars in (("stop", STOPS), ("mark", MARKS)):
        table[[ord(c) for c in chars]] = CLASSES.index(name)
    table[48:58], table[65:91], table[97:123] = (CLASSES.index(c) for c in ("digit", "upper", "lower"))
    table[128:192], table[192:] = len(CLASSES), CLASSES.index("foreign")
    return table


CLASS_OF = _class_table()


class Counts:
    """What the rules need of a column of texts, row by row; all arrays are as long as the words or bytes."""

    def __init__(self, column: pa.Array) -> None:
        self.n = len(column)
        filled = pc.fill_null(column.cast(pa.large_string()), "")
        data, rows = flat_bytes(filled)
        row = np.repeat(np.arange(self.n), np.diff(rows))
        wide = len(CLASSES) + 1
        self.classes = np.bincount(row * wide + CLASS_OF[data], minlength=self.n * wide).reshape(self.n, wide)[:, :-1]
        split = pc.ascii_split_whitespace(filled)
        words, row = split.flatten(), pc.list_parent_indices(split).to_numpy()
        some = pc.greater(pc.binary_length(words), 0)
        self.row = row[some.to_numpy(zero_copy_only=False)]
        self.n_words = np.bincount(self.row, minlength=self.n)
        coded = words.filter(some).dictionary_encode()
        self.ids, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.lines = pc.split_pattern(filled, "\n")

    @property
    def word_chars(self) -> np.ndarray:
        return self.classes.sum(axis=1) - self.classes[:, CLASSES.index("blank")]

    @property
    def n_symbols(self) -> np.ndarray:
        return self.classes[:, CLASSES.index("mark")]

    def n_dup_lines(self) -> np.ndarray:
        lines, row = self.lines.flatten(), pc.list_parent_indices(self.lines).to_numpy()
        some = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
        row = row[some.to_numpy(zero_copy_only=False)]
        coded = lines.filter(some).dictionary_encode()
        first = np.unique(row * max(1, len(coded.dictionary)) + coded.indices.to_numpy())
        of = np.bincount(first // max(1, len(coded.dictionary)), minlength=self.n)
        return np.bincount(row, minlength=self.n) - of

    def n_repeat_words(self) -> np.ndarray:
        """Words in windows of three that stand twice or more in their text."""
        whole = np.flatnonzero(self.row[2:] == self.row[:-2])
        if not len(whole):
            return np.zeros(self.n, np.int64)
        size = len(self.distinct)
        pair = np.unique(self.ids[whole] * size + self.ids[whole + 1], return_inverse=True)[1]
        three = np.unique(pair * size + self.ids[whole + 2], return_inverse=True)[1]
        _, own, count = np.unique(
            self.row[whole] * (int(three.max()) + 1) + three, return_inverse=True, return_counts=True
        )
        at = whole[count[own] > 1]
        held = np.zeros(len(self.row), bool)
        for k in range(3):
            held[at + k] = True
        return np.bincount(self.row[held], minlength=self.n)

    def plain(self) -> pa.Array:
        """The distinct words as the histograms know them; different words may become equal."""
        return pc.utf8_trim(pc.ascii_lower(self.distinct), characters=TRIMMED)


def reference_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, class, n) over all labelled documents: either the word or the class is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "word", "class", "n"]
        for batch in text_chunks(batches, limit=REFERENCE_BYTES):
            found = Counts(batch.column("text"))
            lang = batch.column("lang").dictionary_encode()
            of, langs = lang.indices.to_numpy(), lang.dictionary
            sums = np.zeros((len(langs), len(CLASSES)), np.int64)
            np.add.at(sums, of, found.classes)
            k, c = np.nonzero(sums)
            none = pa.nulls(len(k), pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(k)), none, pa.array(c, pa.int32()), sums[k, c]], names)
            plain = found.plain().dictionary_encode()
            ids = plain.indices.to_numpy()[found.ids] if len(found.ids) else found.ids
            size = max(1, len(plain.dictionary))
            keys, n = np.unique(of[found.row] * size + ids, return_counts=True)
            words = plain.dictionary.take(pa.array(keys % size)).cast(pa.string())
            none = pa.nulls(len(keys), pa.int32())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(keys // size)), words, none, n], names)

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    parts = rows.dropna().mapInArrow(run, "lang string, word string, class int, n bigint")
    return parts.groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))


def references(docs: DataFrame) -> dict:
    """Languages with their class shares and their common words with shares.

    What comes to the driver is bounded by ``SHARE`` and ``COMMON``. The counts are written once, as three
    questions are put to them; frequent words are ranked in two steps, so that no task ranks a vocabulary.
    """
    counts = stored(reference_counts(docs), "quality-counts")
    classes, words = counts.filter("class is not null"), counts.filter("class is null")
    whole = classes.agg(F.sum("n")).first()[0] or 0
    sizes = classes.groupBy("lang").agg(F.sum("n").alias("chars")).filter(F.col("chars") >= F.lit(SHARE * whole))
    langs = sorted(r["lang"] for r in sizes.collect())
    # a list of at most 1,000 names, so that no table is shuffled by language
    named = F.col("lang").isin(langs)
    table = np.zeros((len(langs), len(CLASSES)))
    for r in classes.filter(named).collect():
        table[langs.index(r["lang"]), r["class"]] = r["n"]
    own = words.filter(named)
    totals = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    order = [F.col("n").desc(), F.col("word").asc()]
    salted = own.filter("word <> ''").withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)))
    for part in (["lang", "salt"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        salted = salted.withColumn("place", place).filter(F.col("place") <= COMMON)
    common: dict[str, dict[str, float]] = {lang: {} for lang in langs}
    for r in salted.collect():
        common[r["lang"]][r["word"]] = r["n"] / totals[r["lang"]]
    return {"langs": langs, "classes": table / np.maximum(1, table.sum(axis=1, keepdims=True)), "words": [common[x] for x in langs]}


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the reference shares."""
    p = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    q = np.broadcast_to(reference, p.shape)
    middle = (p + q) / 2
    total = np.zeros(len(p))
    for side in (p, q):
        share = np.divide(side, middle, out=np.ones_like(middle), where=side > 0)
        total += (side * np.log2(share)).sum(axis=1) / 2
    return np.sqrt(np.maximum(0, total))


class Judge:
    """Distances of texts to the references."""

    def __init__(self, model: dict) -> None:
        self.langs, self.classes = model["langs"], model["classes"]
        known = sorted({w for words in model["words"] for w in words})
        self.known = pa.array(known, pa.large_string())
        self.slots, self.words = [], []
        for words in model["words"]:
            slot = np.full(len(known) + 1, len(words), np.int64)
            for k, w in enumerate(words):
                slot[known.index(w)] = k
            self.slots.append(slot)
            self.words.append(np.array([*words.values(), max(0.0, 1 - sum(words.values()))]))

    def __call__(self, found: Counts, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The distances of classes and words; NaN where nothing is compared."""
        far = np.full((2, found.n), np.nan)
        if not self.langs:
            return far[0], far[1]
        number = {x: k for k, x in enumerate(self.langs)}
        own = np.array([number.get(x, -1) for x in langs], np.int64)
        named = np.array([x is not None for x in langs], bool)
        at = pc.fill_null(pc.index_in(found.plain(), value_set=self.known), len(self.known)).to_numpy()
        slot = at[found.ids] if len(found.ids) else found.ids
        enough = [found.classes.sum(axis=1) >= CLASS_LEAST, (found.n_words >= WORD_LEAST) & ((own >= 0) | ~named)]
        for k in range(len(self.langs)):
            rows = np.flatnonzero((own == k) | (own < 0))
            if not len(rows):
                continue
            place = np.full(found.n, -1)
            place[rows] = np.arange(len(rows))
            taken = place[found.row] >= 0
            wide = len(self.words[k])
            cell = place[found.row[taken]] * wide + self.slots[k][slot[taken]]
            held = np.bincount(cell, minlength=len(rows) * wide).reshape(-1, wide)
            for i, apart in enumerate((distance(found.classes[rows], self.classes[k]), distance(held, self.words[k]))):
                far[i, rows] = np.fmin(far[i, rows], apart)
        for i in (0, 1):
            far[i, ~enough[i]] = np.nan
        return np.round(far[0], DIGITS), np.round(far[1], DIGITS)


def allowed(n_words: np.ndarray) -> np.ndarray:
    """The largest word distance that passes, for texts of so many words."""
    return np.sqrt(WORD_FAR**2 + COMMON / (8 * math.log(2) * np.maximum(1, n_words)))


VERDICT = (
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
    ("class_distance", T.DoubleType()),
    ("word_distance", T.DoubleType()),
)


def judged(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` (text, lang and others) with the columns of ``VERDICT`` in the place of text and lang."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c not in ("text", "lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in text_chunks(batches):
            found = Counts(batch.column("text"))
            repeats, words = found.n_repeat_words(), found.n_words
            failed = (words < BASE_WORDS) | (100 * repeats > 50 * words)
            classes, common = judge(found, batch.column("lang").to_pylist())
            good = ~failed & ~(classes > CLASS_FAR) & ~(common > allowed(words))
            out = [words, found.word_chars, found.n_symbols, found.n_dup_lines(), repeats]
            columns = [pa.array(x, pa.int64()) for x in out] + [pa.array(failed), pa.array(good)]
            columns += [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in (classes, common)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *columns], [*kept, *(name for name, _ in VERDICT)]
            )

    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(*field) for field in VERDICT])
    return rows.mapInArrow(run, schema)


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, that the rules keep."""
    text = F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    return judged(docs.select(*text), references(docs)).filter("kept").select("_row.*")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return judged(rows, references(docs))


def _sql() -> str:
    """The same in DuckDB, with one row per doc_id."""
    kinds = {
        "lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "blank": "[^\\x09-\\x0D ]", "stop": "[^.,;:!?''\"()-]",
        "mark": "[^#*$%&|<>]", "foreign": "[\\x00-\\x7F]", "control": "[^\\x00-\\x08\\x0E-\\x1F\\x7F]",
    }
    counted = ", ".join(f"length(regexp_replace(t, '{kinds[c]}', '', 'g'))" for c in kinds)
    upper = "".join(chr(c) for c in range(65, 91))
    trimmed = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum()).replace("'", "''")
    plain = f"trim(translate(w, '{upper}', '{upper.lower()}'), '{trimmed}' || chr(0))"
    half = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
    apart = f"round(sqrt(greatest(0, sum({half.format('p', 'q')} + {half.format('q', 'p')}) / 2)), {DIGITS})"
    return f"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
words AS MATERIALIZED (
  SELECT doc_id, lang, w, i FROM (
    SELECT doc_id, lang, regexp_extract_all(t, '[^\\x09-\\x0D ]+') AS ws FROM docs
  ), LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i)
),
windows AS (
  SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
repeated AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM windows WHERE w3 IS NOT NULL
  ) WHERE n > 1
),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x09-\\x0D ]') GROUP BY doc_id
),
sizes AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS chars FROM words GROUP BY doc_id),
parts AS (SELECT doc_id, lang, length(t) AS chars, [{counted}] AS c FROM docs),
classes AS MATERIALIZED (
  SELECT doc_id, lang, chars, unnest(list_append(c, chars - list_sum(c))) AS n, unnest(range({len(CLASSES)})) AS class
  FROM parts
),
class_sums AS (SELECT lang, class, sum(n) AS n FROM classes WHERE lang IS NOT NULL GROUP BY ALL),
langs AS (
  SELECT lang, sum(n) AS n FROM class_sums GROUP BY lang
  QUALIFY sum(n) > 0 AND sum(n) >= {SHARE} * sum(sum(n)) OVER ()
),
class_refs AS (SELECT c.lang, c.class, c.n / l.n AS q FROM class_sums c JOIN langs l USING (lang)),
plain AS MATERIALIZED (SELECT doc_id, lang, {plain} AS w FROM words),
word_sums AS MATERIALIZED (SELECT lang, w, count(*) AS n FROM plain JOIN langs USING (lang) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM word_sums GROUP BY lang),
common AS (
  SELECT s.lang, s.w, s.n / t.n AS q FROM word_sums s JOIN totals t USING (lang) WHERE s.w <> ''
  QUALIFY row_number() OVER (PARTITION BY s.lang ORDER BY s.n DESC, s.w) <= {COMMON}
),
word_refs AS (SELECT * FROM common UNION ALL SELECT lang, NULL, greatest(0, 1 - sum(q)) FROM common GROUP BY lang),
compared AS (
  SELECT d.doc_id, l.lang, d.lang IS NOT DISTINCT FROM l.lang OR d.lang IS NULL AS judged FROM docs d, langs l
  WHERE d.lang = l.lang OR d.lang IS NULL OR d.lang NOT IN (SELECT lang FROM langs)
),
class_far AS (
  SELECT doc_id, min(far) AS far FROM (
    SELECT c.doc_id, r.lang, {apart} AS far FROM (
      SELECT doc_id, class, n / chars AS p FROM classes WHERE chars >= {CLASS_LEAST}
    ) c JOIN compared USING (doc_id) JOIN class_refs r USING (lang, class) GROUP BY ALL
  ) GROUP BY doc_id
),
held AS (
  SELECT c.doc_id, c.lang, k.w, count(*) AS n FROM plain p JOIN compared c USING (doc_id)
  LEFT JOIN common k ON k.lang = c.lang AND k.w = p.w WHERE c.judged GROUP BY ALL
),
word_far AS (
  SELECT doc_id, min(far) AS far FROM (
    SELECT c.doc_id, r.lang, {apart} AS far FROM (
      SELECT c.doc_id, r.lang, coalesce(h.n, 0) / s.n AS p, r.q FROM compared c JOIN sizes s USING (doc_id)
      JOIN word_refs r USING (lang)
      LEFT JOIN held h ON h.doc_id = c.doc_id AND h.lang = r.lang AND h.w IS NOT DISTINCT FROM r.w
      WHERE c.judged AND s.n >= {WORD_LEAST}
    ) c JOIN (SELECT lang FROM langs) r USING (lang) GROUP BY ALL
  ) GROUP BY doc_id
),
rules AS (
  SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, coalesce(s.chars, 0)::BIGINT AS word_chars,
    p.c[6]::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    coalesce(s.n, 0) < {BASE_WORDS} OR 100 * coalesce(r.n, 0) > 50 * coalesce(s.n, 0) AS base_failed,
    cf.far AS class_distance, wf.far AS word_distance
  FROM docs d JOIN parts p USING (doc_id) LEFT JOIN sizes s USING (doc_id) LEFT JOIN lines l USING (doc_id)
  LEFT JOIN repeats r USING (doc_id) LEFT JOIN class_far cf USING (doc_id) LEFT JOIN word_far wf USING (doc_id)
)
SELECT *, NOT base_failed AND coalesce(class_distance, 0) <= {CLASS_FAR} AND coalesce(word_distance, 0)
  <= sqrt({WORD_FAR} * {WORD_FAR} + {COMMON} / (8 * ln(2) * greatest(1, n_words))) AS kept
FROM rules
"""


OP12_SQL = _sql()
