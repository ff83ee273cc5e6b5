"""Language identification by compression.

Each language has a zstandard dictionary of raw text. A text belongs to the language
whose dictionary compresses it to the fewest bytes. Texts are compressed in pieces, so
that the dictionary, not the text's own beginning, decides about a long one as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import columns_of, giving_back, text_rows

#: Bytes of text in a dictionary, dictionaries of a language, and texts drawn for them on average: bounds of the labelled
#: sample. Of a drawn text no more characters are read than all dictionaries of a language have bytes.
DICTIONARY = 112 * 1024
BOOKS = 3
SAMPLE = 240
LEAST = 4096
PIECE = 8192
LEVEL = 5
#: If the best size is below the next by less than this share, the further dictionaries of both are asked as well.
UNSURE = 0.04
#: A language with too little text for a dictionary has to win by this share.
RARE = 0.1
#: If it then is below the next by less than this share, all dictionaries are asked at the level CLOSE, with FILLER before
#: the text, without which the format stores a short text as it is; if it still is, the text is rejected.
MARGIN = 0.002
CLOSE, FILLER = 19, b"\0" * 128

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"\P{L}+")


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Text of each value of lang, from labelled rows (doc_id, text, lang) outside the held-out fifth.

    About SAMPLE texts of each language are drawn by a hash of doc_id, one at least, and
    laid end to end in that order, as far as BOOKS dictionaries go.
    """
    most = BOOKS * DICTIONARY
    rows = columns_of(docs, "doc_id", "text", "lang").where(
        (F.col("lang") != UNKNOWN) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))
    )
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()
    if not sizes:
        return {}
    limits = [max(r["least"], int(min(1.0, SAMPLE / r["n"]) * (1 << 40)) - 1) for r in sizes]
    limit = F.create_map(*[F.lit(x) for r, n in zip(sizes, limits, strict=True) for x in (r["lang"], n)])
    drawn = rows.where(F.col("draw") <= limit[F.col("lang")]).select("lang", "draw", F.substring("text", 1, most).alias("text"))
    texts: dict[str, list[tuple[int, str]]] = {r["lang"]: [] for r in sizes}
    for row in drawn.distinct().collect():
        texts[row["lang"]].append((row["draw"], row["text"]))
    return {k: b" ".join(plain(t) for _, t in sorted(v))[:most] for k, v in sorted(texts.items())}


def plain(text: str) -> bytes:
    """The text in lower case, its runs of other characters than letters as one space."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def _least(sizes: dict[str, int]) -> tuple[str, float]:
    """The name of the least size, the first of equal ones, and by how large a share it is below the next."""
    order = sorted((n, k) for k, n in sizes.items())
    return order[0][1], (order[1][0] - order[0][0]) / order[1][0] if len(order) > 1 else 1.0


class Classifier:
    """Compares texts by dictionaries of one size.

    Languages with half as much text as the second largest (of no more than a dictionary),
    and LEAST bytes, set the size for all of them. Any other takes part only in this: its
    own text, short as it is, must compress better than the best of those by RARE. So a
    stray label changes no other result.
    """

    def __init__(self, texts: dict[str, bytes]):
        second = sorted(map(len, texts.values()))[-2:][:1]
        enough = max(LEAST, min([DICTIONARY, *second]) / 2)
        enough = min(enough, max(map(len, texts.values()), default=0))
        size = min([DICTIONARY, *[len(x) for x in texts.values() if len(x) >= enough]])
        self.texts = texts
        self.rare = [k for k, x in texts.items() if len(x) < enough]
        self.books = {
            k: [x[i : i + size] for i in range(0, max(1, len(x) - size + 1), size)] for k, x in texts.items() if len(x) >= enough
        }
        self.compressors: dict[tuple[bytes, int], zstandard.ZstdCompressor] = {}

    def _size(self, pieces: list[bytes], book: bytes, level: int = LEVEL) -> int:
        if (book, level) not in self.compressors:
            data = zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            own = zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_dict_id=False, level=level)
            self.compressors[book, level] = own
        compress = self.compressors[book, level].compress
        return sum(len(compress(p)) for p in pieces)

    def _best(self, pieces: list[bytes]) -> tuple[str, float]:
        """The best of the languages with dictionaries, and the margin to the next."""
        sizes = {k: self._size(pieces, books[0]) for k, books in self.books.items()}
        name, share = _least(sizes)
        if len(sizes) == 1:
            return name, share
        two = sorted(sizes, key=lambda k: (sizes[k], k))[:2]
        for i in range(1, min(len(self.books[k]) for k in two)):
            if share < UNSURE:
                sizes = {k: sizes[k] + self._size(pieces, self.books[k][i]) for k in two}
                name, share = _least(sizes)
        if share < MARGIN:
            filled = [FILLER + p for p in pieces]
            common = min(map(len, self.books.values()))
            name, share = _least({k: sum(self._size(filled, b, CLOSE) for b in books[:common]) for k, books in self.books.items()})
        return name, share

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, margin): by how large a share the best size is below the next."""
        if not text or not self.texts or not _LETTER.search(text):
            return UNKNOWN, 0.0
        data = plain(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        name, margin = self._best(pieces)
        found = []
        for rare in self.rare:
            base = self._size(pieces, self.books[name][0])
            gain = (base - self._size(pieces, self.texts[rare])) / base
            if gain >= RARE:
                found.append((-gain, rare))
        return (min(found)[1], -min(found)[0]) if found else (name, margin)


def identify(docs: DataFrame, texts: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, lang_pred, score, rejected.

    score is the margin, 0 to 1. Texts without letters, null and empty ones are `und`
    with score 0. They are rejected, as are those whose margin is below `margin`. Of
    equal sizes the first language by name is taken. Without labelled texts every row is
    `und`. Repeated rows are repeated; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(texts)
        for batch in batches:
            found = [classify(text) for (text,) in text_rows([batch], "text")]
            names, scores = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array([n == UNKNOWN or s < margin for n, s in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean"
    )


def accepted(docs: DataFrame, texts: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of `docs`, all columns, that `identify` does not reject."""

    @giving_back()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(texts)
        for batch in batches:
            found = [classify(text) for (text,) in text_rows([batch], "text")]
            yield batch.filter(pa.array([n != UNKNOWN and s >= margin for n, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
