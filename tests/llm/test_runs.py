"""op11: runs of words against all periods and starts, its plain reading of the query, and hard sequences."""

import hashlib
import random
import re
import zlib

from siteatlas.llm.periodic_runs import find_runs, run_digest, with_planted_periods, word_runs
from siteatlas.llm.queries import op11_periodic_runs
from tests.llm.corpora import documents, frame


def all_runs(w, min_length, min_exponent):
    """Every maximal stretch of every period, kept where no smaller period holds."""
    n, found = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            start, end = i, j + p
            long_enough = end - start >= max(min_length, min_exponent * p)
            if long_enough and not any(all(w[k] == w[k + q] for k in range(start, end - q)) for q in range(1, p)):
                found.add((start, end - start, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_match_every_period():
    rng = random.Random(3)
    for _ in range(3000):
        letters = "abcd"[: rng.randint(1, 4)]
        w: list[str] = []
        while len(w) < rng.randint(0, 50):
            root = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
            w += root * rng.randint(1, 6) if rng.random() < 0.6 else (root * 3 + root[:1]) * 2
        for limits in ((6, 4), (2, 2), (1, 3)):
            assert word_runs(w, *limits) == all_runs(w, *limits), (w, limits)


class Counted:
    """A word that counts the comparisons it takes part in."""

    n = 0

    def __init__(self, x):
        self.x = x

    def __eq__(self, other):
        Counted.n += 1
        return self.x == other.x

    def __lt__(self, other):
        Counted.n += 1
        return self.x < other.x


def test_comparisons_grow_with_the_words():
    fib, other = [0, 1], [0]
    while len(fib) < 4000:
        fib, other = fib + other, fib
    texts = {
        "one word": [1] * 4000,
        "two words": [0, 1] * 2000,
        "fibonacci": fib[:4000],
        "falling": list(range(4000, 0, -1)),
        "growing blocks": sum(([0] * k + [1] for k in range(90)), []),
        "nested": (([0] * 9 + [1]) * 9 + [2]) * 44,
    }
    for name, w in texts.items():
        Counted.n = 0
        word_runs([Counted(x) for x in w])
        assert Counted.n < 12 * len(w), name


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain(doc_id, text):
    """The query's row by its definition."""
    words = planted(doc_id, text)
    runs = all_runs(words, 6, 4)
    goes = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None,) * 3),
        best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in goes)),
    )


def rows_to_check():
    rows = [(i, t if t is None or len(t) < 3000 else t[:900]) for i, t in documents()]
    rng = random.Random(5)
    for i in range(600, 660):
        rows.append((i, "\t".join(rng.choice(["ab", "Ab", "é", "c\x85d"]) for _ in range(rng.randint(1, 90)))))
    return [*rows, (700, "go " * 700), (701, "a b c " * 40 + "x y " + "b a\n" * 30), (702, "z")]


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_matches_its_definition(spark):
    rows = rows_to_check()
    out = run_digest(find_runs(with_planted_periods(frame(spark, rows))))
    assert out.columns == COLUMNS and {t for _, t in out.dtypes} == {"bigint", "string"}
    want = sorted((plain(*r) for r in rows), key=repr)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert sum(r[1] > 0 for r in want) > 10


def test_query_reads_the_table(spark, tmp_path):
    rows = [(i, t) for i, t in rows_to_check() if i is not None and i < 560]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = op11_periodic_runs(spark, str(tmp_path)).select(COLUMNS).collect()
    assert sorted(map(tuple, out), key=repr) == sorted((plain(*r) for r in rows), key=repr)


def test_real_outputs_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "so so so so so so  end\n"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in find_runs(docs).collect()}
    assert [tuple(r) for r in found[1].runs] == [(0, 6, 1)] and found[1].collapsed == "so end" and found[1].n_words == 7
    assert found[2].runs == [] and found[2].collapsed == ""
    assert run_digest(find_runs(with_planted_periods(docs.limit(0)))).count() == 0
