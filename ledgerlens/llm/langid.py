"""Language ID by language-bitmask n-gram filters.

For each language the n-grams (4 bytes of UTF-8, letters lower-cased, all else a space) that it contains go
into one slice of a bit-sliced Bloom filter: row ``h`` holds, in bit l, whether language l has set
position h. One lookup, an AND of two rows, returns all languages that contain the n-gram. A
document counts, per language, how many of its n-grams the language contains; the count is
corrected for the slice's false positives, and the largest share decides.

A language contains an n-gram that makes up at least SHARE of its own ones, and at least RELATIVE of the share
that it has where it is most frequent. Both are shares, so a small language keeps what a large one does, and
a language has 1 / SHARE n-grams at most, however much it was learned from. The filter's rows are as many
as the n-grams ask for. They are put together on the executors: the driver gets the filter alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ledgerlens.llm.common import written

UNDETERMINED = "und"
#: Logarithm of the filter's rows at least; there are 4 or more for each n-gram of the language that contains most, so that every slice is set to two fifths at most.
LOG_ROWS = 12
#: What an n-gram's share in a language is at least, and as part of its largest share in any language.
SHARE, RELATIVE = 1e-6, 0.1
#: Text that is counted, and that is scored, at once; scoring takes about 60 bytes for each byte of it.
COUNT_BYTES, SCORE_BYTES = 4 << 20, 1 << 19

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _normal(text: str | None) -> bytes:
    """Letters lower-cased (A-Z), every run of other ASCII one space, a space at both ends."""
    return b" " + b" ".join((text or "").encode("utf-8").translate(_TABLE).split()) + b" "


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def _codes(data: bytes):
    """4-byte n-grams as uint32; texts shorter than that are padded by the caller."""
    import numpy as np

    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    return a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16) | a[3:] << np.uint32(24)


def _rows(codes, log_rows: int):
    """The two filter rows of each n-gram."""
    import numpy as np

    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    mask = np.uint64((1 << log_rows) - 1)
    return (x >> np.uint64(32)) & mask, x & mask


@dataclass
class LanguageFilters:
    """languages: in order of their bits; rows: uint64[a power of 2, words]; fill: set share of each slice."""

    languages: list[str]
    rows: object
    fill: list[float]

    def counts(self, texts: list[str | None]):
        """(n-grams, corrected count per language) of each text."""
        import numpy as np

        parts = [_normal(t) for t in texts]
        parts = [p if len(p) >= 4 else p.ljust(4) for p in parts]
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        codes = _codes(b"".join(parts))
        one, two = _rows(codes, (len(self.rows) - 1).bit_length())
        n = lengths - 3
        out = np.zeros((len(parts), len(self.languages)))
        for word in range(self.rows.shape[1]):
            mask = self.rows[one, word] & self.rows[two, word]
            for bit, at in enumerate(range(word * 64, min(len(self.languages), word * 64 + 64))):
                total = np.concatenate(([0], np.cumsum((mask >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
                hit = total[starts + n] - total[starts]  # n-grams that reach into the next text are not counted
                false = self.fill[at] ** 2
                out[:, at] = np.clip((hit - n * false) / max(1e-9, 1 - false), 0, n)
        return n, out


def gram_counts(labelled: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n) over all rows whose language is not null."""

    def batches(rows):
        import numpy as np
        import pyarrow as pa

        def told(lang, parts):
            data = b"   ".join(parts)
            grams, n = np.unique(_codes(data if len(data) >= 4 else data.ljust(4)), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in rows:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = _normal(text.as_py())
                waiting.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part)
                if size[lang] > COUNT_BYTES:
                    yield told(lang, waiting.pop(lang))
                    size[lang] = 0
        for lang, parts in waiting.items():
            yield told(lang, parts)

    counted = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = counted.mapInArrow(batches, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def contained(counts: DataFrame, totals: DataFrame, share: float = SHARE, relative: float = RELATIVE) -> DataFrame:
    """(lang, gram) of the n-grams that each language contains, of counts (lang, gram, n) and totals (lang, total)."""
    shares = counts.join(F.broadcast(totals), "lang").select("gram", F.struct((F.col("n") / F.col("total")).alias("p"), "lang").alias("x"))
    grams = shares.where(F.col("x.p") >= share).groupBy("gram").agg(F.collect_list("x").alias("xs"), F.max("x.p").alias("most"))  # a row for each language at most
    return grams.select("gram", F.explode("xs").alias("x"), "most").where(F.col("x.p") >= relative * F.col("most")).select("x.lang", "gram")


def fit(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", share: float = SHARE, relative: float = RELATIVE) -> LanguageFilters:
    """Filters of all languages of ``labelled``; rows without a language don't count, null texts count as empty.

    The driver gets a number for each language and the filter: 8 bytes a row for each 64 languages, 32 MB at most, as SHARE
    leaves a language a million n-grams and these ask for 2^22 rows.
    """
    import numpy as np

    spark = labelled.sparkSession
    counts = written(gram_counts(labelled, lang_col, text_col), "grams")
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageFilters([], np.zeros((1 << LOG_ROWS, 1), dtype=np.uint64), [])
    grams = written(contained(counts, spark.createDataFrame(list(totals.items()), "lang string, total long"), share, relative), "contained")
    most = max((r["n"] for r in grams.groupBy("lang").agg(F.count("*").alias("n")).collect()), default=1)
    log_rows = max(LOG_ROWS, (4 * most - 1).bit_length())
    place = {lang: i for i, lang in enumerate(languages)}

    def batches(parts):
        import pyarrow as pa

        for batch in parts:
            at = np.array([place[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            both = np.concatenate(_rows(batch.column(1).to_numpy().astype(np.uint32), log_rows)).astype(np.int64)
            at = np.concatenate([at, at])
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array((at // 64).astype(np.int32)), pa.array((np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64))], names=["at", "word", "bits"])

    # every slice's row is set once, so no more rows come back than the filter has
    got = grams.mapInArrow(batches, "at long, word int, bits long").groupBy("at", "word").agg(F.bit_or("bits").alias("bits")).toPandas()
    rows = np.zeros((1 << log_rows, -(-len(languages) // 64)), dtype=np.uint64)
    rows[got["at"].to_numpy(), got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    fill = [float(((rows[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
    return LanguageFilters(languages, rows, fill)


def identify(docs: DataFrame, filters: LanguageFilters, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``docs``, then pred_col and score_col; columns of those names are replaced.

    score is the corrected share of the text's n-grams that the language contains. Null texts and
    those without a letter are `und` with score 0, as is everything if no language was learned; every other
    text gets a learned language. Ties go to the language that sorts first. Repeated rows stay; empty tables stay empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.rows, filters.fill))  # 32 MB at most for each 64 languages
    keep = [c for c in docs.columns if c not in (pred_col, score_col)]
    docs = docs.select(*keep)
    at = keep.index(text_col)

    def batches(rows):
        import numpy as np
        import pyarrow as pa

        model = LanguageFilters(*shared.value)
        for batch in rows:
            names, scores, texts, size = [], [], [], 0

            def flush(texts=texts, names=names, scores=scores):
                if not texts:
                    return
                n, counts = model.counts(texts)
                best = counts.argmax(axis=1) if model.languages else None
                for i, t in enumerate(texts):
                    known = model.languages and has_letter(t)
                    names.append(model.languages[best[i]] if known else UNDETERMINED)
                    scores.append(float(counts[i, best[i]] / n[i]) if known else 0.0)
                texts.clear()

            for value in batch.column(at):
                text = value.as_py()
                texts.append(text)
                size += len(text or "")
                if size > SCORE_BYTES:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.array(scores, dtype=np.float64))], names=[*keep, pred_col, score_col])

    schema = StructType([*docs.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())])
    return docs.mapInArrow(batches, schema)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether crc32 of the id as text falls into the held-out fold; a null id never does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
