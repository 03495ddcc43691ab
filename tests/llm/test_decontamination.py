import random
import re

from siteatlas.llm.decontamination import contamination_report, drop_contaminated, find_contamination
from siteatlas.llm.wu_manber import WuManber
from tests.llm.corpora import SCHEMA, documents, frame, lower


def test_search_matches_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        text = bytes(rng.choice(b"ab c") for _ in range(rng.choice([5, 200, 2000])))
        some = {bytes(rng.choice(b"ab c") for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 33, 70]))) for _ in range(12)}
        some |= {text[i : i + rng.choice([1, 4, 12, 20, 40])] for i in range(0, len(text), 97)}
        patterns = list(some)
        expected = sorted((i, k) for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i))
        assert sorted(WuManber(patterns).search(text)) == expected


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(rows, items):
    out = []
    for i, text in rows:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            q = words(t)
            for k in range(max(len(q) - 9, 1) if q else 0):
                win = q[k : k + 10]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        ids.add("" if item is None else str(item))
        out.append((str(i), len(w), len(hit), len(ids), bool(hit)))
    return sorted(out)


def cases():
    rows = [(i, t if t is None or len(t) < 4000 else t[:4000]) for i, t in documents()]
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[3:25])), (2, texts[1].upper()[:200] + "..."), (10, "one"), (None, "two, words!"), (3, None), (4, "?!"), (5, "one")]
    return rows, items


def test_matches_brute_force_in_one_pass_and_in_many(spark):
    rows, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(rows, items)
    for block in (16 << 20, 100):
        found = contamination_report(find_contamination(frame(spark, rows), benchmark, block_bytes=block))
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect())
        assert got == expected


def test_drop(spark):
    rows, items = cases()
    docs = frame(spark, rows)
    kept = drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == [b[0] for b in brute(rows, items) if not b[4]]


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(none, items).collect() == []
    assert all(not r.contaminated for r in contamination_report(find_contamination(frame(spark, documents()), items)).collect())


def test_drop_decides_by_row_where_ids_are_null_or_repeat(spark):
    bad, items = "a b c d e f g h i j k", [(1, "a b c d e f g h i j")]
    rows = [(None, bad), (None, "clean"), (None, None), (7, bad), (7, "clean too"), (8, "clean")]
    for block in (16 << 20, 10):
        kept = drop_contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
        assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
            [("None", "clean"), ("None", "None"), ("7", "clean too"), ("8", "clean")]
        )


def test_a_stage_searches_for_one_block(spark):
    """However many blocks the benchmark needs, the last stage has one worker and one block's tables; the rest is written."""
    rows = documents()
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(40)] + [(99, rows[20][1])]
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(frame(spark, rows), tests, block_bytes=100)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = contamination_report(find_contamination(frame(spark, rows), tests)).collect()
    assert sorted(map(str, contamination_report(found).collect())) == sorted(map(str, want))
