"""op12: alignment of two tokenisations against a plain walk over the tokens of whole texts."""

import hashlib
from collections import Counter

import pytest

from siteatlas.llm.queries import op12_token_alignment
from siteatlas.llm.token_alignment import BYTE_LEVEL, PIECES, align_tokens, aligned, alignment_digest, byte_of_symbol, cut_texts, parts
from tests.llm.corpora import documents, frame

NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
AWKWARD = [
    (801, "a\n b  c\t d\n\n  e "),
    (802, "x ▁ y"),
    (803, "<|endoftext|> <s> </s> <0x41> hi"),
    (804, "dup 　 \x1c z\x85 q    r"),
    (805, "漢字かな交じり文がずっと続く" * 40),
    (806, "👩‍👩‍👧 emoji é é ﬁ"),
    (807, "  two before, two after  "),
    (808, "\x00 null ​ zero"),
    (None, "an id that is null"),
]


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def plain(texts):
    """The contract's numbers for whole texts, by walking both token lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    symbol, rows, counts = byte_of_symbol(), [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        by_a = [bytes(symbol[c] for c in a.id_to_token(i)) for i in ids_a]
        by_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(by_a) != want or b"".join(by_b) != want:
            rows.append(None)
            continue
        end_a, end_b = ends(by_a), ends(by_b)
        links = []
        for i, e in enumerate(end_a):
            links += [(ids_a[i], ids_b[j]) for j, f in enumerate(end_b) if f > e - len(by_a[i]) and f - len(by_b[j]) < e]
        groups, i, j = [], 0, 0
        for cut in sorted(set(end_a) & set(end_b)):
            k, m = end_a.index(cut) + 1, end_b.index(cut) + 1
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            i, j = k, m
        counts.update(links)
        rows.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (0, 0, 0, 0, 0, 0, "")
        if r is None
        else (*r[:3], len(r[3]), sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), hashlib.sha256(r[4].encode()).hexdigest())
        for r in rows
    ]


@pytest.fixture(scope="module")
def rows():
    short = [(i, t if t is None or len(t) < 6000 else t[:3000]) for i, t in documents()]
    return short + AWKWARD + [short[12], AWKWARD[0]]


def test_query_matches_a_walk_over_the_tokens(spark, rows, tmp_path):
    want = sorted(((i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows]), strict=True)), key=repr)
    out = alignment_digest(align_tokens(frame(spark, rows)))
    assert out.columns == NAMES and [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == want
    assert [r[1:] for r in got if r[0] == 802] == [(0, 0, 0, 0, 0, 0, "")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, op12_token_alignment(spark, str(tmp_path)).collect()), key=repr) == want


def test_parts_join_to_the_text():
    for _, t in AWKWARD:
        assert " ".join(parts(t)) == t
    assert parts("a b  c\n d") == ["a", "b", " c\n d"]


def test_links_of_one_long_group(spark):
    """Tokens of 3 and of 2 bytes meet every 6 bytes; where they never meet, all is one group with as many links as ends."""
    lengths = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, length int")
    units = spark.createDataFrame([(1, 0, [3, 3], [2, 2, 2]), (2, 0, [1] + [2] * 500, [2] * 500 + [1])], "part int, batch long, a_ids array<int>, b_ids array<int>")
    out = aligned(units, lengths, lengths).orderBy("part", "end").collect()
    assert [(r.end, r.a_id, r.b_id, r.group) for r in out if r.part == 1] == [(2, 3, 2, 1), (3, 3, 2, 1), (4, 3, 2, 1), (6, 3, 2, 1)]
    second = [r for r in out if r.part == 2]
    assert len(second) == 1001 and {r.group for r in second} == {1}


def test_empty_table(spark):
    assert alignment_digest(align_tokens(frame(spark, documents()).limit(0))).count() == 0


def test_parts_of_one_shape_are_aligned_once(spark):
    """However many words there are, the sorts and joins of an alignment have a row for each token of a shape, not of a word."""
    words = [f"{x}{y}{z}" for x in "bdfg" for y in "aeiou" for z in "klmnprst"]
    found = cut_texts(frame(spark, [(1, " ".join(words)), (2, " ".join(words[::-1]))]).coalesce(1), ("byte_level", BYTE_LEVEL), ("sentence_pieces", PIECES))
    shapes = [(tuple(r.a_ids), tuple(r.b_ids)) for r in found.where("part is not null").collect()]
    slices = found.where("slice is not null").orderBy("slice").collect()
    assert len(set(shapes)) == len(shapes) < 20
    assert sum(len(r.shapes) for r in slices) == len(words) and {n for r in slices for n in r.uses} == {2}
    assert all(sum(a) == sum(b) == 4 for a, b in shapes)
