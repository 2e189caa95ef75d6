"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Each side's token numbers are repeated over the bytes of their tokens (byte-owner arrays). Where either owner changes a new
overlap begins, and each pair of neighbours that overlap is met once; where both change at one byte the text is cut, and
the tokens between two cuts are a group.

How often two ids are linked is a count over the corpus. Texts are encoded once: a task writes segments of up to
``SEGMENT_LINKS`` links, each with its distinct id pairs and, packed, how often each document has them. Pairs are summed
over segments by a shuffle, joined back by pair, and a segment's documents are finished from its own pairs: what is shuffled
is a row for each distinct pair of a segment, not for each link, and nothing is broadcast.

Null and empty texts have no tokens, nor have texts whose tokens' bytes on either side are not those of the text: zeros and an
empty digest. Every row of a repeated id or text counts. A null id stays null. An empty table gives no rows. Long texts are
encoded whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.common import written

FOLDER = "/opt/tokenizers"
#: Links of a segment, besides those of its last text.
SEGMENT_LINKS = 1_000_000
#: Ids of the second tokenizer are below this.
_SHIFT = 20


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """A byte-level BPE from a tokenizer file, without special tokens.

    Where merges are numbered in their order, as ids are, a rank-driven encoder gives the same ids in a fifth of the time; it is used if
    the file shows that order and the usual pattern, the file's own library otherwise.
    """

    def __init__(self, file: str):
        raw = json.loads(Path(file).read_text("utf-8"))
        letters = _byte_letters()
        special = {t["content"] for t in raw.get("added_tokens", [])}
        vocabulary = {k: i for k, i in raw["model"]["vocab"].items() if k not in special}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for k, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in k)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in raw["model"]["merges"]]
        in_order = [vocabulary.get(m) for m in merges] == list(range(256, 256 + len(merges))) and all(len(b) == 1 for b in self.bytes[:256])
        if in_order and raw["pre_tokenizer"] == _BYTE_LEVEL and not raw.get("normalizer") and len(vocabulary) == 256 + len(merges):
            import tiktoken

            self.encode = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes)}, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(file)
            whole.encode_special_tokens = True
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids


_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Fixed value: how byte-level BPE splits text before merging.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceTokenizer:
    """A sentence-piece model, which puts a space before the text itself."""

    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = range(self.model.get_piece_size())
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@functools.lru_cache(maxsize=2)
def tokenizers(folder: str = FOLDER) -> tuple[ByteTokenizer, PieceTokenizer]:
    """Both sides, loaded once a worker."""
    return ByteTokenizer(f"{folder}/byte_bpe_50k.json"), PieceTokenizer(f"{folder}/piece_bpe_32k.model")


def owners(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, group of each a, group of each b): token numbers of each overlap, and the groups between common ends.

    Both sides cover the same bytes, and no token is empty.
    """
    own_a, own_b = np.repeat(np.arange(len(lengths_a)), lengths_a), np.repeat(np.arange(len(lengths_b)), lengths_b)
    new_a, new_b = np.ones(len(own_a), bool), np.ones(len(own_b), bool)
    new_a[1:], new_b[1:] = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
    at = np.flatnonzero(new_a | new_b)
    group = np.cumsum(new_a & new_b) - 1
    return own_a[at], own_b[at], group[new_a], group[new_b]


class Writer:
    """Groups as text: a|b;a|b with ids joined by commas, each id's string looked up with what follows it."""

    def __init__(self, n_a: int, n_b: int):
        self.ids = np.array([f"{i}{after}" for after in ",|;" for i in range(max(n_a, n_b))] , object)
        self.n = max(n_a, n_b)

    def text(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True], np.r_[group_b[1:] != group_b[:-1], True]
        strings = np.r_[a + self.n * last_a, b + 2 * self.n * last_b]
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        return "".join(self.ids[strings[order]].tolist())[:-1]


@functools.lru_cache(maxsize=2)
def _writer(folder: str) -> Writer:
    a, b = tokenizers(folder)
    return Writer(len(a.bytes), len(b.bytes))


def align(text: str | None, folder: str = FOLDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(ids of A, ids of B, a and b of each overlap, group of each a, of each b); None without tokens."""
    if not text:
        return None
    first, second = tokenizers(folder)
    spaced = " " + text
    raw = spaced.encode("utf-8", "surrogatepass")
    try:
        a, b = first.encode(spaced), second.encode(text)
    except UnicodeError:
        return None
    if b"".join([first.bytes[i] for i in a]) != raw or b"".join([second.bytes[i] for i in b]) != raw:
        return None
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return (a, b, *owners(first.lengths[a], second.lengths[b]))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def segments(docs: DataFrame, folder: str = FOLDER, segment_links: int = SEGMENT_LINKS) -> DataFrame:
    """(segment, ids, n_a, n_b, n_groups, n_links, digests, pairs, totals, packed) of stretches of ``docs``.

    ``pairs`` are the distinct id pairs in order and ``totals`` their links; ``packed`` has for each document, in turn, how
    many pairs it has, then their numbers as steps, then the links of each.
    """

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, found, links = [], [], 0
        for pdf in it:
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                got = align(t if isinstance(t, str) else None, folder)
                if got is None:
                    rows.append((k, 0, 0, 0, 0, ""))
                    found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                else:
                    a, b, over_a, over_b, group_a, group_b = got
                    digest = hashlib.sha256(_writer(folder).text(a, b, group_a, group_b).encode()).hexdigest()
                    rows.append((k, len(a), len(b), int(group_a[-1]) + 1, len(over_a), digest))
                    found.append(np.unique(a[over_a] << _SHIFT | b[over_b], return_counts=True))
                    links += len(over_a)
                if links >= segment_links or len(rows) >= segment_links // 50:
                    yield segment(rows, found)
                    rows, found, links = [], [], 0
        if rows:
            yield segment(rows, found)

    def segment(rows: list[tuple], found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        pairs, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        n = np.concatenate([c for _, c in found])
        sizes = np.array([len(p) for p, _ in found], np.int64)
        starts = np.cumsum(sizes) - sizes
        steps = np.diff(at, prepend=0)
        steps[starts[sizes > 0]] = at[starts[sizes > 0]]  # a document's numbers start anew
        press = zstandard.ZstdCompressor(3).compress
        packed = [press(x.astype(np.int32).tobytes()) for x in (sizes, steps, n)]
        ids, *numbers, digests = zip(*rows, strict=True)
        columns = {"ids": [ids], **{c: [np.array(v, np.int64)] for c, v in zip(_COUNTS, numbers, strict=True)}, "digests": [digests]}
        return pd.DataFrame(columns | {"pairs": [pairs.astype(np.int64)], "totals": [np.bincount(at, n, len(pairs)).astype(np.int64)], "packed": [packed]})

    rows = docs.select(F.col("doc_id").cast("string").alias("k"), F.col("text").alias("t"))
    schema = f"ids array<string>, {', '.join(f'{c} array<long>' for c in _COUNTS)}, digests array<string>, pairs array<long>, totals array<long>, packed array<binary>"
    return rows.mapInPandas(pack, schema).withColumn("segment", F.monotonically_increasing_id())


def pair_counts(stored: DataFrame) -> DataFrame:
    """(pair, count, best) of every id pair of ``segments``: its links over all, and whether no pair of its second id has more."""
    each = stored.select(F.explode(F.arrays_zip("pairs", "totals")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.totals").alias("count"))
    second = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    return each.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(second)))


def alignment(docs: DataFrame, folder: str = FOLDER, segment_links: int = SEGMENT_LINKS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text)."""
    stored = written(segments(docs, folder, segment_links), "token-segments")
    counted = written(pair_counts(stored), "token-pairs")
    asked = stored.select("segment", F.posexplode("pairs").alias("at", "pair"))
    known = asked.join(counted, "pair").groupBy("segment").agg(F.collect_list(F.struct("at", "count", "best")).alias("known"))
    rows = stored.drop("pairs", "totals").join(known, "segment", "left")

    def finish(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples(index=False):
                held = row.known if row.known is not None else []
                count, best = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
                at = np.fromiter((x["at"] for x in held), np.int64, len(held))
                count[at], best[at] = [x["count"] for x in held], [x["best"] for x in held]
                sizes, steps, n = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int32).astype(np.int64) for x in row.packed)
                starts = np.cumsum(sizes) - sizes
                moved = np.cumsum(steps)
                place = moved - np.repeat(moved[np.minimum(starts, max(len(steps) - 1, 0))] - steps[np.minimum(starts, max(len(steps) - 1, 0))], sizes) if len(steps) else moved
                sums = [np.r_[0, np.cumsum(x)] for x in (n * best[place], n * count[place])]
                n_best, count_sum = (s[starts + sizes] - s[starts] for s in sums)
                yield pd.DataFrame({"doc_id": row.ids, **{c: getattr(row, c) for c in _COUNTS}, "n_best": n_best, "count_sum": count_sum, "groups_sha256": row.digests})

    numbers = ", ".join(f"{c} long" for c in (*_COUNTS, "n_best", "count_sum"))
    kind = docs.schema["doc_id"].dataType
    return rows.mapInPandas(finish, f"doc_id string, {numbers}, groups_sha256 string").withColumn("doc_id", F.col("doc_id").cast(kind))
