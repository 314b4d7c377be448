"""Shards against sums row by row."""

import brute
import pytest
from conftest import CLASHING, frame

from dwelltrace.llm.shards import place_in_shards, read_shard, write_shards


def placed(docs, **options):
    out = place_in_shards(docs, **options).collect()
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out), key=str)


@pytest.mark.parametrize("shards", [1, 3, 8, 40])
def test_shards_are_contiguous_and_even(documents, rows, shards):
    expected = brute.shards([(d, t or "") for d, t, _ in rows], shards)
    assert placed(documents, shards=shards) == sorted(expected, key=str)


def test_dealing_does_not_matter(spark, rows, documents):
    assert placed(frame(spark, rows, 1)) == placed(frame(spark, rows, 11)) == placed(documents)


def test_sizes_are_near_their_target(spark):
    docs = frame(spark, [(i, "x" * (i * 37 % 101), "s") for i in range(2000)])
    sums = [0] * 8
    for _, size, _, shard, _ in placed(docs):
        sums[shard] += size
    assert max(sums) - min(sums) <= 102


def test_odd_rows(nothing, no_ids):
    assert placed(nothing) == []
    expected = brute.shards([(r.doc_id, r.text or "") for r in no_ids.select("doc_id", "text").collect()])
    assert placed(no_ids) == sorted(expected, key=str)
    with pytest.raises(ValueError):
        place_in_shards(nothing, shards=0)


def test_many_rows_without_id_spread_over_partitions(spark, monkeypatch):
    from dwelltrace.llm import shards

    docs = frame(spark, [(None, "the same text", "s")] * 3000 + [(i, f"text {i}", "s") for i in range(3000)])
    seen = {}

    def watched(df, purpose):
        out = staged(df, purpose)
        if purpose == "shard-places":
            seen.update({r.part: r["count"] for r in out.groupBy("part").count().collect()})
        return out

    staged = shards.staged
    monkeypatch.setattr(shards, "staged", watched)
    assert placed(docs) == sorted(brute.shards([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]), key=str)
    assert max(seen.values()) < 6000 / len(seen) * 2


def test_written_shards_hold_whole_rows_in_order(spark, documents, rows, tmp_path):
    path = str(tmp_path / "shards")
    write_shards(documents, path, shards=3)
    expected = brute.shards([(d, t or "") for d, t, _ in rows], 3)
    for shard in range(3):
        out = read_shard(spark, path, shard)
        assert out.columns == documents.columns and set(CLASHING) <= set(out.columns)
        assert [r.doc_id for r in out.collect()] == [d for d, _, _, s, _ in expected if s == shard]
    assert sorted(map(str, spark.read.parquet(path).select("doc.*").collect())) == sorted(map(str, documents.collect()))
