"""Mixing, sharding, exact copies, licences, quality and the archive beyond their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from altloom.llm import archive, exact, licenses, mixing, quality, sharding
from altloom.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def filled(sizes, weights, epochs):
    """Water-filling as it is told: clamp, reshare, until none is above."""
    target, clamped, total = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in clamped]
        mass = total - sum(epochs * sizes[s] for s in clamped)
        for s in free:
            target[s] = weights[s] * mass / sum(weights[f] for f in free)
        over = {s for s in free if target[s] > epochs * sizes[s]}
        if not over:
            return target
        clamped |= over
        target |= {s: float(epochs * sizes[s]) for s in over}


def test_mix(spark, tables, odd_rows):
    got = QUERIES["op1_mix"](spark, tables).collect()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert sorted(map(repr, got)) == sorted(map(repr, QUERIES["op1_mix"](spark, tables).collect()))
    sizes = Counter()
    for _, text, _, source, _ in odd_rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    target = filled(dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    named = {repr(r): r for r in mixing.mix(docs).select("source", "source_size", "target").distinct().collect()}.values()
    assert {r.source: (r.source_size, pytest.approx(r.target)) for r in named} == {s: (sizes[s], target[s]) for s in sizes}
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    largest = Counter()
    for _, text, _, source, _ in odd_rows:
        largest[source] = max(largest[source], len(WORD.findall(text or "")))
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)


def test_mix_where_all_are_clamped(spark):
    rows = [(k, "a b", "s", 0) for k in range(10)] + [(k, "", "t", 0) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, more int")
    found = mixing.mix(docs, weights=(1,), epochs=1).agg(F.sum("taken"), F.min("target")).first()
    assert tuple(found) == (20, 0.0)
    again = mixing.repeated(docs, weights=(1,), epochs=1)
    assert again.columns == docs.columns and again.filter("source = 's'").count() == 10


def test_repeated_rows_of_a_mix(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    plan = {r.doc_id: r.copies for r in mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").alias("copies")).collect()}
    held = Counter(r[0] for r in docs.select("doc_id").collect())
    got = Counter(r[0] for r in out.select("doc_id").collect())
    assert got == Counter({d: held[d] * n for d, n in plan.items() if n})


def test_shards(spark, tables, odd_rows):
    rows = QUERIES["op10_shards"](spark, tables).collect()
    places, full = defaultdict(list), Counter()
    for r in rows:
        places[r.shard].append(r.slot)
        full[r.shard] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None} and set(places) == set(range(8))
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_slot_maps():
    rng = random.Random(1)
    totals = [(s, rng.randint(0, 5000), 1) for s in range(4096)]
    size = {s: b for s, b, _ in totals}
    old = sharding.first_map(totals, 4096, 8)
    full = Counter()
    for s, k in old.items():
        full[k] += size[s]
    assert max(full.values()) - min(full.values()) <= 5000
    grown = sharding.rebalanced(old, totals, 9)
    moved = [s for s in old if grown[s] != old[s]]
    assert {grown[s] for s in moved} == {8}
    full = Counter()
    for s, k in grown.items():
        full[k] += size[s]
    assert full[8] > 0.9 * sum(size.values()) / 9
    assert set(sharding.rebalanced(old, totals, 7).values()) == set(range(7))
    assert sharding.rebalanced(old, totals, 8) == old


def test_maps_of_little_are_even():
    assert set(Counter(sharding.first_map([], 8192, 8).values()).values()) == {1024}
    totals = [(s, 100 + s % 7, 1) for s in range(1000)]
    found = sharding.first_map(totals, 8192, 8)
    assert max(Counter(found.values()).values()) - min(Counter(found.values()).values()) <= 1
    full = Counter()
    for s, b, _ in totals:
        full[found[s]] += b
    assert max(full.values()) - min(full.values()) <= 106


def test_a_stored_map_is_loaded_edited_and_stored_again(spark, tmp_path):
    place = f"file://{tmp_path}/map"
    docs = spark.createDataFrame([(k, "x" * (k % 50)) for k in range(3000)], "doc_id int, text string")
    first = sharding.shard(docs, 4, 64, place).collect()
    again = sharding.shard(docs, 4, 64, place).collect()
    assert sharding.versions(spark, place) == [1] and sorted(map(tuple, first)) == sorted(map(tuple, again))
    grown = sharding.shard(docs, 5, 64, place).collect()
    assert sharding.versions(spark, place) == [1, 2]
    old, new = sharding.load(spark, place, 1)[0], sharding.load(spark, place)[0]
    assert {new[s] for s in old if new[s] != old[s]} == {4} and len(new) == 64
    before = {r.doc_id: r.shard for r in first}
    assert {r.shard for r in grown if r.shard != before[r.doc_id]} == {4} and {r.shard for r in grown} == set(range(5))


def test_assignment_of_the_query(spark, tables):
    rows = QUERIES["op10_shards"](spark, tables).collect()
    size, slot_of = Counter(), {}
    for r in rows:
        size[r.virtual_slot] += r["size"]
        assert slot_of.setdefault((r.doc_id, r.text_crc32), r.virtual_slot) == r.virtual_slot
    full, want = [0] * 8, {}
    for slot in sorted(size, key=lambda s: (-size[s], s)):
        least = min(range(8), key=lambda k: (full[k], sum(x == k for x in want.values()), k))
        want[slot] = least
        full[least] += size[slot]
    assert all(r.shard == want[r.virtual_slot] for r in rows)
    assert max(full) - min(full) <= max(size.values())


@pytest.mark.parametrize(("rounds", "fan_in"), [(1, 2), (3, 2), (2, 5)])
def test_tree_merge_of_any_shape(spark, tables, odd_rows, rounds, fan_in):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    found = exact.duplicates(docs, rounds, fan_in).collect()
    normal = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for r in odd_rows:
        groups[normal(r[1])].append(r[0])
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_one_row_of_each_text_stays(spark, tables, odd_rows):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = exact.without_copies(docs)
    assert out.columns == docs.columns
    texts = [re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in odd_rows})


def test_licence_forms(spark):
    known = licenses.known_digests(spark)
    full = licenses.KNOWN[-1][1]
    rows = [
        (1, "Copyright (c) 2020 A. Writer\nAll rights reserved.\n\n" + full.upper().replace(", ", " ,\n")),
        (2, "# LICENCED under the apache licence -- version 2.0"), (3, "words\n* Released under the MIT Licence!\nwords"),
        (4, "Released under the MIT License. And more"), (5, None), (6, ""), (7, "(c) 2021\n© 2022"),
        (8, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License."),
    ]
    found = {r.doc_id: (r.license, r.notices, r.n_notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string"), known).collect()}
    assert found == {
        1: ("0BSD", "", 0), 2: ("Apache-2.0", "Apache-2.0", 1), 3: (None, "MIT", 1), 4: (None, "", 0), 5: (None, "", 0),
        6: (None, "", 0), 7: (None, "", 0), 8: (None, "CC-BY-NC-4.0,MIT", 3),
    }


def test_quality_needs_no_python_and_no_shuffle(spark, tables):
    plan = QUERIES["op4_quality_rules"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_quality_rules_are_a_table(spark):
    text = " ".join(f"word{k} the" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text.replace(" the", " ###the")), (3, None)], "doc_id int, text string")
    assert {r.doc_id: r.kept for r in quality.judged(docs).collect()} == {1: True, 2: False, 3: False}
    strict = quality.judged(docs, [("stop_word_share", 0.6, None)])
    assert not any(r.kept for r in strict.collect())


def test_archive_gives_back_the_records(spark, tables):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    found = archive.write(pages)
    rows = archive.records(spark, found).collect()
    want = sorted((r.html or "").encode() for r in pages.collect())
    assert sorted(bytes(r.payload) for r in rows) == want
    assert spark.read.parquet(found.payloads).count() == len(set(want))
    whole = {r.page_id: bytes(r.record) for r in archive.record_bytes(archive.records(spark, found)).collect()}
    html = {r.page_id: r.html or "" for r in pages.collect()}
    for r in rows:
        assert whole[r.page_id].startswith(bytes(r.header)) and whole[r.page_id].startswith(b"WARC/1.1\r\n")
        if r.record_type == "response":
            assert whole[r.page_id] == bytes(r.header) + html[r.page_id].encode() + b"\r\n\r\n"
        else:
            assert html[r.refers_to] == html[r.page_id] and r.refers_to < (r.page_id if r.page_id is not None else 1 << 60)


def test_addresses_cannot_add_header_lines(spark):
    urls = ["http://x\r\nX-Refers-To-Page: 99", "http://x\nWARC-Type: revisit\r\n\r\nblock", "\x00\x1f\x7f", "plain", "é", None, "a\r\n\r\n"]
    rows = [(k, url, f"body\r\n\r\n{k % 3}") for k, url in enumerate(urls)]
    found = archive.records(spark, archive.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"))).collect()
    got = {r.page_id: (r.record_type, r.refers_to, bytes(r.payload).decode(), r.header_digest == r.payload_digest) for r in found}
    assert got == {k: ("response" if k < 3 else "revisit", None if k < 3 else k % 3, html, True) for k, _, html in rows}
    assert {r.page_id: r.address for r in found}[0] == "http://x%0D%0AX-Refers-To-Page: 99"
    assert all(bytes(r.header).count(b"\r\n") == (8 if r.record_type == "response" else 10) + 1 for r in found)


def test_small_payloads_are_responses(spark, tables):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    found = archive.records(spark, archive.write(pages, least=1))
    assert found.filter("payload_bytes = 0 AND record_type = 'revisit'").count() == 0
    assert found.filter("record_type = 'revisit'").count() > 0


def test_a_changed_payload_is_an_error(spark, tables):
    found = archive.write(spark.read.parquet(f"{tables}/pages.parquet"))
    other = found.payloads + "-other"
    spark.read.parquet(found.payloads).withColumn("payload", F.concat("payload", F.lit(b"x"))).write.parquet(other)
    with pytest.raises(Exception, match="digest"):
        archive.records(spark, archive.Archive(found.headers, other)).select("payload_digest").collect()
