import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import token_align as ta

BIG = 2**53 + 1


def plain(text):
    """Ids and links by the tokenizers' own libraries and a loop over all pairs of tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{ta.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{ta.FOLDER}/piece_bpe_32k.model")
    letters = ta._byte_letters()
    if not text:
        return None
    a = t.encode(" " + text, add_special_tokens=False)
    b = sp.encode(text)
    bytes_a = [bytes(letters[c] for c in x) for x in a.tokens]
    bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    spans = lambda ends: list(zip([0, *ends], ends))  # noqa: E731, B905
    links = [(i, j) for i, (p, q) in zip(a.ids, spans(ends_a), strict=True) for j, (r, s) in zip(b, spans(ends_b), strict=True) if max(p, r) < min(q, s)]
    cuts, groups, ia, ib = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for c in cuts:
        ja, jb = ends_a.index(c) + 1, ends_b.index(c) + 1
        groups.append(",".join(map(str, a.ids[ia:ja])) + "|" + ",".join(map(str, b[ib:jb])))
        ia, ib = ja, jb
    return len(a.ids), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


TEXTS = [
    "Hello world, cross tokenizers don't align.", "", None, "  two  spaces\tand\ttabs\n\n\nlines ", "naïve café 東京 😀👨‍👩‍👧 ﷺ", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ is a piece mark", " ", "\n", "a",
    "1234567890" * 20, "x" * 3000, "Ωμέγα ЖЖЖ ß ſ İ", "Hello world, cross tokenizers don't align.", "  　 wide", "é combining", "\x00\x01 control \x7f",
]


def test_alignment_against_plain_loops(spark):
    rows = list(zip([1, 2, None, BIG, -(2**63), *range(10, 10 + len(TEXTS) - 5)], TEXTS, strict=True)) + [(1, TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("no") for c in ("k", "t", "segment", "ids", "pairs")})
    want = [(k, plain(t)) for k, t in rows]
    total = Counter(p for _, x in want if x for p in x[3])
    most = Counter()
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    expected = sorted(
        ((k, *((x[0], x[1], x[2], len(x[3]), sum(total[p] == most[p[1]] for p in x[3]), sum(total[p] for p in x[3]), x[4]) if x else (0, 0, 0, 0, 0, 0, ""))) for k, x in want), key=repr
    )
    for links in (ta.SEGMENT_LINKS, 150):
        got = ta.alignment(docs.repartition(3), segment_links=links).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
        assert sorted(map(tuple, got), key=repr) == expected
    assert sum(x is None for _, x in want) >= 3  # null, empty, the piece mark


def test_long_text_and_rank_driven_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{ta.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    first, _ = ta.tokenizers()
    assert "encode_ordinary" in repr(first.encode)
    rng = np.random.default_rng(3)
    points = rng.integers(1, 0x3000, (400, 30))
    texts = ["".join(chr(c) for c in row) for row in points] + [" ".join(map(str, row)) for row in points[:5]] + ["lorem ipsum, " * 20_000]
    assert all(first.encode(x) == t.encode(x, add_special_tokens=False).ids for x in texts)


def test_empty_table_gives_no_rows(spark):
    assert ta.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("a,b,links,groups", [([3], [1, 2], 2, 1), ([1, 1], [1, 1], 2, 2), ([2, 2], [1, 2, 1], 4, 1)])
def test_owners(a, b, links, groups):
    over_a, over_b, group_a, group_b = ta.owners(np.array(a), np.array(b))
    assert len(over_a) == len(over_b) == links and group_a[-1] + 1 == group_b[-1] + 1 == groups
