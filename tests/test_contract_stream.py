"""Contracts of a stream against contracts of all its rows at once."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from siteatlas.operators import contracts
from siteatlas.streaming.contracts import contract_stream, contracts_so_far, parts_in

SCHEMA = contracts.OBSERVATION + ", fetched_at timestamp"
EPOCH = dt.datetime(2026, 1, 1)


def request(rng, n):
    path = rng.choice(["/api/a", "/api/b", "/rpc"])
    body = rng.choice(["", "", '{"q": 1, "mode": "x"}', f'{{"q": {n}}}', "a=1&b=two", '{"jsonrpc":"2.0","method":"m%d","params":{"z":1}}' % (n % 3)])
    return {
        "url": f"https://h{path}?page={rng.randrange(4)}&k={rng.choice('xy')}",
        "method": rng.choice(["GET", "post", ""]),
        "headers": [{"name": "Content-Type", "value": rng.choice(["application/json", "application/x-www-form-urlencoded"])}] if body else [],
        "body": body,
        "response_fields": [{"path": "id", "kind": rng.choice(["any", "int"])}] if n % 5 == 0 else [],
        "endpoint_only": n % 11 == 0,
        "method_inferred": n % 2 == 0,
        "inferred_query": [{"name": "t", "value": ""}] if n % 7 == 0 else [],
        "seq": n,
        "fetched_at": (EPOCH + dt.timedelta(minutes=n)).isoformat(),
    }


def as_text(tables):
    return {k: sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in t.collect()) for k, t in tables.items()}


def run(spark, folder, late=None, fan=3, only=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    query = contract_stream(stream, f"file://{folder}/parts", late, fan).option("checkpointLocation", str(folder / "state"))
    assert query.trigger(availableNow=True).start().awaitTermination(300)


def send(folder, n, rows):
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / f"{n:03}.json").write_text("\n".join(map(json.dumps, rows)))


def test_stream_equals_all_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [request(rng, n) for n in range(60)]
    for k in range(5):
        send(tmp_path, k, rows[k * 12 : k * 12 + 12])
        if k in (2, 4):  # stopped in between, and started again from the checkpoint
            run(spark, tmp_path)
    assert parts_in(spark, f"file://{tmp_path}/parts") == [(0, 2), (3, 3), (4, 4)]
    whole = contracts.infer_contracts(spark.read.schema(SCHEMA).json(str(tmp_path / "in")))
    assert as_text(contracts_so_far(spark, f"file://{tmp_path}/parts")) == as_text(whole)


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    from siteatlas.streaming.contracts import merge_full_levels, write_part

    rng = random.Random(3)
    batches = [spark.createDataFrame(spark.read.schema(SCHEMA).json(spark.sparkContext.parallelize([json.dumps(request(rng, n)) for n in range(k * 5, k * 5 + 5)])).rdd, SCHEMA) for k in range(2)]
    folder = f"file://{tmp_path}/parts"
    for k in (0, 1, 1):
        write_part(contracts.partial_contracts(batches[k]), folder, k, k)
    merge_full_levels(spark, folder, 2, 12)
    assert parts_in(spark, folder) == [(0, 1)]
    assert as_text(contracts_so_far(spark, folder)) == as_text(contracts.infer_contracts(batches[0].union(batches[1])))


def test_late_and_equal_requests(spark, tmp_path):
    rng = random.Random(4)
    rows = [request(rng, n) for n in range(20)]
    send(tmp_path, 0, rows)
    again = [{**r, "seq": r["seq"] + 100, "fetched_at": (EPOCH + dt.timedelta(minutes=5)).isoformat()} for r in rows[:6]]
    send(tmp_path, 1, again)
    send(tmp_path, 2, [{**request(rng, 300), "fetched_at": (EPOCH + dt.timedelta(days=1)).isoformat()}])
    late = {**request(rng, 400), "url": "https://h/late?x=1", "fetched_at": EPOCH.isoformat()}
    send(tmp_path, 3, [late])
    run(spark, tmp_path, late="1 hour")
    ends = contracts_so_far(spark, f"file://{tmp_path}/parts")["endpoints"]
    assert not ends.where(F.col("path").contains("late")).count()
    distinct = {(r["method"], r["url"], r["body"], json.dumps(r["headers"])) for r in rows if not r["endpoint_only"]}
    total = ends.agg(F.sum("calls")).first()[0]
    assert len(distinct) - 2 <= total <= len(distinct) + 1


def test_nothing_yet(spark, tmp_path):
    assert contracts_so_far(spark, f"file://{tmp_path}/none") == {}
