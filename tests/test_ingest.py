"""Concatenated JSON: damaged objects, and files cut into ranges."""

import json

import pytest

from cadence.plans import ingest

OBJECTS = [f'{{"id":"{i}","x":{{"t":"a {{ \\" }}"}},"l":[\n{{"n":{i}}},\n  {{"n":[]}}]}}' for i in range(4)]
TEXTS = [
    "\n".join(OBJECTS), " ".join(OBJECTS), "", " \n ", "}}}", "\n{", '{"id":"1"} bad" {"id":"2"}\n{"id":"3"}',
    '{"id":"1"\n{"id":"2"}\n{"id":"3"}\n', '{"id":"1","x":{"y":1}\n{"id":"2"}\n{"id":"3"}\n', '{"id":"1}\n{"id":"2"}\n\n{"id":"3"}',
    '{"id":"1",\n{"id":"2"}\n{"id":"3"}\n{"id":"4"}', '{"a":"\\\\"}\n{"a":"\\', 'x\n{"a":1}\ny{"b":2}\n{"c":"\n{"d":3}\n',
]


def told(text):
    objects, rest = ingest.object_spans(text)
    return [text[a:b] for a, b in objects], [text[a:b].strip() for a, b in rest]


def test_recovery():
    assert told(TEXTS[0])[0] == OBJECTS and told(TEXTS[1])[0] == OBJECTS
    assert told(TEXTS[6]) == (['{"id":"1"}', '{"id":"2"}', '{"id":"3"}'], ['bad"'])
    for t in TEXTS[7:11]:
        objects, rest = told(t)
        assert [json.loads(o)["id"] for o in objects][-2:] == (["3", "4"] if '"4"' in t else ["2", "3"]) and len(rest) == 1
    for t in TEXTS:  # nothing is lost
        objects, rest = ingest.object_spans(t)
        kept = "".join(t[a:b] for a, b in sorted(objects + rest))
        assert "".join(kept.split()) == "".join(t.split())


def test_a_file_cut_anywhere(spark):
    """Ranges of every size give the rows of the whole text."""
    want, rows = {}, []
    for f, t in enumerate(TEXTS):
        for size in [1, 2, 3, 5, 7, 11, 19, 40, 1000]:
            name = f"{f}/{size}"
            want[name] = sorted([("o", x) for x in told(t)[0]] + [("b", x) for x in told(t)[1]])
            rows += [(name, i, t[i:i + size]) for i in range(0, len(t), size)] or [(name, 0, None)]
    df = spark.createDataFrame(rows, "file string, at long, value string").repartition(5)
    got = {name: [] for name in want}
    for r in ingest.split_json_ranges(df, ["file"], ["at"]).collect():
        got[r.file].append(("b", r.bad) if r.obj is None else ("o", r.obj))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_sound_stretches_are_split_by_states():
    """Every cut of texts of whole objects is split from its pieces alone;
    damaged ones are told."""
    sound = [OBJECTS[0].replace("\n", " "), " ".join(OBJECTS).replace("\n", ""), '{"a":"\\\\"} {"b":"\\"{"}', '  {"a":[{},\n{"b":{}}]}{}']
    for text in sound:
        for size in (1, 2, 3, 7, 20):
            parts = [text[i:i + size] for i in range(0, len(text), size)]
            found = ingest._states([ingest._outline(p) for p in parts])
            objects, open_ones = [], {}
            for n, (p, (state, depth, owner)) in enumerate(zip(parts, found)):
                head, whole, tail = ingest._cut(p, state, depth)
                objects += whole
                if head is not None:
                    open_ones.setdefault(owner, []).append(head)
                if tail is not None:
                    open_ones.setdefault(n, []).append(tail)
            assert sorted(objects + ["".join(x) for x in open_ones.values()]) == sorted(told(text)[0])
    for text in ['{"a":1}}', '{"a":1', 'x{"a":1}', '"', '{"a":"\n"}', '{"a":1\n{"b":1}}', '{"a":{}}y{}']:
        for size in (1, 2, 3):
            assert ingest._states([ingest._outline(text[i:i + size]) for i in range(0, len(text), size)]) is None


def test_one_line_file_is_many_tasks(spark):
    text = "".join(json.dumps({"id": str(i), "x": {"t": 'a{"' * (i % 5)}}) for i in range(500))
    rows = [("f", i, text[i:i + 100]) for i in range(0, len(text), 100)]
    df = spark.createDataFrame(rows, "file string, seam long, piece string").selectExpr("file", "seam at", "piece value")
    got = ingest.split_json_ranges(df, ["file"], ["at"]).collect()
    assert sorted(int(json.loads(r.obj)["id"]) for r in got) == list(range(500))
    edges = df.selectExpr("file", "at", "1 kind", "value piece", "0L seam")
    left, split = ingest._split_stretches(edges, ["file"], ["at"])
    assert left.count() == 0 and split.count() == 500


@pytest.mark.parametrize("chars", [1, 300, 1 << 20])
def test_read_in_ranges(spark, tmp_path, chars):
    for slug in ("1-artist", "2-release"):
        (tmp_path / f"slug={slug}").mkdir()
        for part in range(2):
            lines = [json.dumps({"id": f"{slug}/{part}/{i}", "é": "x" * (i % 50)}, ensure_ascii=False) for i in range(300)]
            (tmp_path / f"slug={slug}" / f"part{part}.json").write_text("\n".join(lines) + "\n{broken")
    ranges = ingest.read_dump_ranges(spark, str(tmp_path), chars)
    records, bad = ingest.scan_entity_dump(ranges)
    want = {(int(s[0]), f"{s}/{p}/{i}") for s in ("1-artist", "2-release") for p in range(2) for i in range(300)}
    assert {(r.packet_number, r.mbid) for r in records.collect()} == want
    assert [r.bad for r in bad.collect()] == ["{broken"] * 4
    if chars < 300:
        assert ranges.count() > 1000
