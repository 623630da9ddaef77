"""Pages that arrive, come late and are sent again, against the batch result of their latest versions."""

import json
import random

import pytest

from tallyspark import schemas
from tallyspark.operators import parse
from tallyspark.streaming import pages as stream


def text(draw):
    return "\n".join(f"{draw.choice(['88135', '88136', '77777'])} {'7290018813505' if draw.random() < 0.8 else ''} x {draw.randrange(1, 9)}" for _ in range(draw.randrange(4)))


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_in_any_order_equal_the_latest_versions(spark, tmp_path, seed):
    draw = random.Random(seed)
    catalog = spark.createDataFrame([("88135", "7290018813505", "a", 6, True, None, None, None), ("88136", "7290018813512", "b", 6, False, None, None, None)], schemas.CATALOG)
    sent = [{"job_id": f"j{j}", "page": p, "version": v, "text": text(draw)} for j in range(3) for p in range(4) for v in range(draw.randrange(1, 5))]
    sent += draw.choices(sent, k=15)  # again
    draw.shuffle(sent)
    sent += [{"job_id": None, "page": 1, "version": 1, "text": "88135 7290018813505 x 1"}, {"job_id": "j9", "page": 1, "version": None, "text": None}]
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    for n in range(4):  # two starts see two files each, in two batches
        some = sent[n * len(sent) // 4 : (n + 1) * len(sent) // 4]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, some)))
        if n % 2:
            stream.append_signed(stream.arriving_versions(spark, str(source), files=1), catalog, out, state).awaitTermination()
    latest = {}
    for s in sent:
        if s["job_id"] is not None:
            key, value = (s["job_id"], s["page"]), (s["version"] or 0, s["text"] or "")
            latest[key] = max(latest.get(key, value), value)
    pages = spark.createDataFrame([(*k, t) for k, (_, t) in latest.items()], schemas.PAGE)
    want = parse.parse_table(pages, catalog).withColumn("sign", parse.F.lit(1))
    got = spark.read.parquet(out)
    rows = lambda frame: sorted(map(str, frame.collect()))
    for keys in (["sku"], ["job_id"], ["job_id", "page", "sku"]):
        assert rows(stream.signed_totals(got, *keys)) == rows(stream.signed_totals(want, *keys))
    assert rows(stream.signed_duplicates(got)) == rows(stream.signed_duplicates(want))
    # the appended rows are those of changes: a version that came late or again has left none
    before = got.count()
    (source / "9.json").write_text("\n".join(map(json.dumps, sent)))
    stream.append_signed(stream.arriving_versions(spark, str(source)), catalog, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == before


def test_a_page_that_becomes_empty_takes_its_rows_back(spark, tmp_path):
    catalog = spark.createDataFrame([], schemas.CATALOG)
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    for version, words in ((1, "88135 7290018813505 x 4"), (2, "")):
        (source / f"{version}.json").write_text(json.dumps({"job_id": "j", "page": 1, "version": version, "text": words}))
        stream.append_signed(stream.arriving_versions(spark, str(source)), catalog, out, state).awaitTermination()
        assert stream.signed_totals(spark.read.parquet(out), "sku").count() == (1 if version == 1 else 0)
    assert [r.sign for r in spark.read.parquet(out).orderBy("sign").collect()] == [-1, 1]


def test_pages_share_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "STATES", 2)
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    seen = []
    for version in (1, 3, 2):
        (source / f"{version}.json").write_text("\n".join(json.dumps({"job_id": f"j{k}", "page": k % 3, "version": version, "text": f"t{version}"}) for k in range(40)))
        keep = lambda rows, _: seen.append(sorted((r.job_id, r.page, r.text, r.sign) for r in rows.collect()))
        signed = stream.signed_pages(stream.arriving_versions(spark, str(source)))
        assert "state#" in signed._jdf.queryExecution().analyzed().toString()
        signed.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    pages = [(f"j{k}", k % 3) for k in range(40)]
    assert seen[0] == sorted((*p, "t1", 1) for p in pages) and seen[1] == sorted([(*p, "t1", -1) for p in pages] + [(*p, "t3", 1) for p in pages])
    assert not any(seen[2:])
