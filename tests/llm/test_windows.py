import random

from siteatlas.llm.license_scan import TEMPLATES, license_scan
from siteatlas.llm.substring_dedup import Paragraphs, substring_dedup, without_spans
from siteatlas.llm.word_hashes import SLICE, Words
from tests.llm.corpora import SCHEMA, documents, frame


def prose(rng, n, stem):
    return [f"{stem}{rng.randrange(5000)}" for _ in range(n)]


def test_words_do_not_depend_on_their_neighbours_or_on_slices():
    texts = [b"", b"A b\nc", b"  lead", b"x " * (SLICE // 2 + 10), "é É".encode()]
    every = Words(texts)
    assert every.counts.tolist() == [0, 3, 1, SLICE // 2 + 10, 2]
    for i, t in enumerate(texts):
        alone = Words([t])
        assert alone.hash.tolist() == every.hash[every.text == i].tolist()
        assert alone.line_start.tolist() == every.line_start[every.text == i].tolist()
    assert Words([b"a B"]).hash.tolist() == Words([b"A b"]).hash.tolist()


def test_paragraphs_cut_alike_in_any_context():
    rng = random.Random(3)
    found = 0
    for _ in range(200):
        passage = prose(rng, 55, "p")
        docs = [" ".join(prose(rng, rng.randrange(3, 60), "a") + passage + prose(rng, rng.randrange(3, 60), "b")).encode() for _ in range(2)]
        p = Paragraphs(docs)
        h, _ = p.hashes()
        found += bool(set(h[p.text == 0]) & set(h[p.text == 1]))
    assert found >= 196


def test_paragraphs_do_not_depend_on_the_batch():
    texts = [(t or "").encode() for _, t in documents()]
    every = Paragraphs(texts)
    h, g = every.hashes()
    for i, t in enumerate(texts):
        alone = Paragraphs([t])
        assert [x.tolist() for x in alone.hashes()] == [h[every.text == i].tolist(), g[every.text == i].tolist()]
        assert alone.first.tolist() == every.first[every.text == i].tolist()


def test_repeats_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(11)
    passage = prose(rng, 64, "p")
    rows = [(i, " ".join(prose(rng, 90, "c"))) for i in range(40)]
    for i in range(40, 60):
        rows.append((i, " ".join(prose(rng, 30, "d") + passage + prose(rng, 30, "e"))))
    found = {r.doc_id: r for r in substring_dedup(frame(spark, rows)).collect()}
    assert all(found[i].n_repeated == 0 for i in range(40))
    assert all(found[i].n_repeated > 0 and 40 in found[i].class_docs for i in range(40, 60))
    assert found[40].n_removed == 0 and all(found[i].n_removed == found[i].n_repeated and list(found[i].kept_in) == [40] for i in range(41, 60))
    texts = dict(rows)
    for i in range(41, 60):
        spans = [(s["first"], s["length"]) for s in found[i].spans]
        gone = [w for a, n in spans for w in texts[i].split()[a : a + n]]
        assert set(gone) <= set(passage)
        assert without_spans(texts[i], spans).split() == [w for k, w in enumerate(texts[i].split()) if not any(a <= k < a + n for a, n in spans)]


def test_near_paragraphs_join_one_class(spark):
    rng = random.Random(5)
    line = prose(rng, 30, "n")
    rows = [(1, "\n".join([" ".join(line)])), (2, " ".join([*line, "tail"])), (3, " ".join(prose(rng, 40, "z")))]
    found = {r.doc_id: r for r in substring_dedup(frame(spark, rows)).collect()}
    assert found[2].n_removed >= 1 and found[3].n_repeated == 0


def test_awkward_documents(spark):
    rows = documents()
    found = substring_dedup(frame(spark, rows)).collect()
    assert len(found) == len({i for i, _ in rows})
    assert sum(r.n_removed for r in found) > 0
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_licenses_are_found_wherever_they_stand(spark):
    rng = random.Random(8)
    rows, expected = [], set()
    for i, (name, text) in enumerate(TEMPLATES * 3):
        before = " ".join(prose(rng, rng.randrange(0, 200), "w"))
        rows.append((i, f"{before} {text.upper() if i % 2 else text} {' '.join(prose(rng, 40, 'v'))}"))
        expected.add((i, name))
    rows += [(1000 + i, " ".join(prose(rng, 80, "q"))) for i in range(20)]
    found = {(r.doc_id, r.license_id): r for r in license_scan(frame(spark, rows)).collect()}
    assert expected <= set(found) and all(found[e].containment == 1.0 for e in expected)
    assert not any(i >= 1000 for i, _ in found)


def test_a_worn_license_is_found_and_half_of_one_is_not(spark):
    name, text = TEMPLATES[5]
    words = text.split()
    worn = [*words]
    worn[10] = worn[70] = "changed"
    found = {(r.doc_id, r.license_id): r.containment for r in license_scan(frame(spark, [(1, " ".join(worn)), (2, " ".join(words[: len(words) // 2]))])).collect()}
    assert 0.8 <= found[1, name] < 1 and (2, name) not in found


def test_licenses_in_awkward_documents(spark):
    assert license_scan(frame(spark, documents())).collect() == []
    assert license_scan(spark.createDataFrame([], SCHEMA)).collect() == []
    short = license_scan(frame(spark, [(1, "two, words"), (2, "two words more")]), [("s", "Two words!"), ("none", "...")])
    assert [(r.doc_id, r.license_id) for r in short.collect()] == [(1, "s")]


def license_words(text):
    import re

    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def license_shingles(text):
    w = license_words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def test_licenses_match_windows_read_one_by_one(spark):
    rng = random.Random(21)
    templates = [(n, t) for n, t in TEMPLATES]
    rows = []
    for i in range(60):
        words = rng.choice(templates)[1].split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = "odd"
        words = words[: rng.randrange(len(words) // 2, len(words) + 1)]
        rows.append((i, " ".join(prose(rng, rng.randrange(0, 60), "w") + words + prose(rng, rng.randrange(0, 60), "v"))))
    expected = {}
    sets = [(n, set(license_shingles(t))) for n, t in templates]
    for i, text in rows:
        s = license_shingles(text)
        for name, t in sets:
            c = 1 << (len(t) - 1).bit_length()
            shares = [(len(t & set(s[k : k + 2 * c])) / len(t), k) for k in range(0, max(len(s), 1), c)]
            good = [(x, k) for x, k in shares if x >= 0.8]
            if good:
                expected[i, name] = (max(x for x, _ in good), len(good), min(k for _, k in good))
    found = {(r.doc_id, r.license_id): (r.containment, r.n_windows, r.first_word) for r in license_scan(frame(spark, rows)).collect()}
    assert found == expected and len(expected) > 10


def test_repeats_match_all_pairs(spark):
    rows = [(i, t) for i, t in documents(5) if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    rng = random.Random(6)
    base = prose(rng, 40, "n")
    for k in range(12):
        w = list(base)
        w[rng.randrange(40)] = f"edit{k}"
        rows.append((2000 + k, " ".join(w)))
    units = []
    for i, t in rows:
        p = Paragraphs([(t or "").encode()])
        words = (t or "").encode().lower().split()
        for number, first, n in zip(p.number.tolist(), p.first.tolist(), p.length.tolist(), strict=True):
            units.append((i, number, tuple(words[first : first + n])))
    classes = sorted({u[2] for u in units})
    shingles = {c: {c[k : k + 5] for k in range(len(c) - 4)} for c in classes}
    root = {c: c for c in classes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(classes):
        for b in classes[:k]:
            common = len(shingles[a] & shingles[b])
            if common >= 0.8 * (len(shingles[a]) + len(shingles[b]) - common):
                root[find(a)] = find(b)
    groups = {}
    for i, number, c in units:
        groups.setdefault(find(c), []).append((i, number))
    repeated, removed = {}, {}
    for members in groups.values():
        if len({i for i, _ in members}) > 1:
            for m in members:
                repeated[m[0]] = repeated.get(m[0], 0) + 1
                removed[m[0]] = removed.get(m[0], 0) + (m != min(members))
    for r in substring_dedup(frame(spark, rows)).collect():
        assert (r.n_repeated, r.n_removed) == (repeated.get(r.doc_id, 0), removed.get(r.doc_id, 0)), r.doc_id


def test_late_members_of_large_buckets_are_compared(spark):
    rng, rows, k = random.Random(12), [], 0
    phrase = prose(rng, 12, "p")
    while len(rows) < 160:  # texts of one paragraph each, whose minima are nearly all in the common phrase
        k += 1
        if k % 20 == 0 and not rows:
            phrase = prose(rng, 12, "p")
        two = [" ".join([*phrase, f"u{k}", f"v{k}", f"{x}{k}"]) for x in "wx"]
        if Paragraphs([t.encode() for t in two]).length.tolist() == [15, 15]:
            rows += [(len(rows) + j, t) for j, t in enumerate(two)]
    found = {r.doc_id: r for r in substring_dedup(frame(spark, rows)).collect()}
    assert all(found[i].n_repeated == 1 and list(found[i].class_docs) == [i - i % 2] for i in range(160))
    assert sum(r.n_removed for r in found.values()) == 80


def test_a_passage_in_short_lines_is_found(spark):
    rng = random.Random(31)
    passage = prose(rng, 56, "p")
    lines = "\n".join(" ".join(passage[k : k + 7]) for k in range(0, 56, 7))
    rows = [(i, f"{' '.join(prose(rng, 5, 'a'))}\n{lines}\n{' '.join(prose(rng, 6, 'b'))}") for i in range(6)]
    rows.append((9, "\n".join(" ".join(prose(rng, 7, "c")) for _ in range(8))))
    found = {r.doc_id: r for r in substring_dedup(frame(spark, rows)).collect()}
    assert all(found[i].removed_words >= 16 and list(found[i].kept_in) == [0] for i in range(1, 6))
    assert found[0].n_removed == 0 and found[9].n_repeated == 0
    for text, p in [(t, Paragraphs([t.encode()])) for _, t in rows]:
        covered = {k for a, n in zip(p.first.tolist(), p.length.tolist(), strict=True) for k in range(a, a + n)}
        assert covered == set(range(len(text.split())))


def test_lines_are_compared_as_a_brute_force_of_its_own_splits_them(spark):
    rng = random.Random(41)
    rows, pairs = [], []
    for k, n in enumerate([8, 9, 12, 15, 20, 30, 50] * 4):
        line = prose(rng, n, f"l{k}_")
        other = list(line)
        if n == 50:
            other[24] = "changed"
        elif n == 15:
            other[-1] = "changed"
        sides = [[" ".join(prose(rng, rng.randrange(5, 30), "z")) for _ in range(2)] for _ in range(2)]
        for w, (before, after) in zip((line, other), sides, strict=True):
            rows.append((len(rows), f"{before}\n{' '.join(w)}\n{after}"))
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (line, other))
        assert len(x & y) >= 0.8 * len(x | y)
        pairs.append((len(rows) - 2, len(rows) - 1))
    found = {r.doc_id: r for r in substring_dedup(frame(spark, rows)).collect()}
    for a, b in pairs:
        before, line, _ = (x.split() for x in rows[b][1].split("\n"))
        gone = {k for s in found[b].spans for k in range(s["first"], s["first"] + s["length"])}
        assert found[a].n_removed == 0 and set(range(len(before), len(before) + len(line))) <= gone, (a, len(line))
        assert found[b].removed_words == len(gone)
