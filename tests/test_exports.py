"""Exports of any size, shape and folder."""

import json
import random

import pytest

from turnstone.sources import exports, splitjson

NOW = 1_750_000_000_000
NASTY = ['}', '{', '"', '\\', '\\"', '[]', '"conversations": [', '\n', 'é', '漢', '{"a": "}"}', '\\\\', ' ', 'plain words', ']}']


def nasty(rng, n=12):
    return "".join(rng.choice(NASTY) for _ in range(rng.randint(0, n)))


def value(rng, depth=0):
    kind = rng.randint(0, 5 if depth < 3 else 2)
    if kind < 3:
        return rng.choice([None, True, 1.5, nasty(rng)])
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {nasty(rng, 3): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


@pytest.fixture
def narrow(spark):
    """Ranges of some bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def to(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "1b")

    yield to
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.mark.parametrize("size,most", [("64m", 100_000), ("37b", 100_000), ("200b", 0)])
def test_objects(spark, tmp_path, narrow, monkeypatch, size, most):
    """Objects of every shape, in files read by ranges of a few bytes, are those that a JSON parser finds."""
    narrow(size)
    monkeypatch.setattr(splitjson, "MOST_RANGES", most)
    rng, want = random.Random(size), {}
    for k in range(12):
        items = [value(rng, 1) if rng.random() < 0.3 else {"id": i, "x": value(rng, 1), nasty(rng, 2): nasty(rng)} for i in range(rng.randint(0, 6))]
        layout = rng.choice([{"indent": 1}, {}, {"separators": (",", ":")}, {"ensure_ascii": False}])
        shape = k % 4
        whole = items if shape == 0 else {"user": value(rng, 2), "more": [{"a": 1}], "conversations": items, "then": {"conversations": [{"no": 1}], "y": value(rng, 2)}} if shape == 1 else {"mapping": {"a": {"b": nasty(rng)}}, "l": items} if shape == 2 else {"conversations": 3, "mapping": {}}
        text = " " * rng.randint(0, 3) + json.dumps(whole, **layout) + "\n" * rng.randint(0, 2)
        (tmp_path / f"f{k}.json").write_bytes((b"\xef\xbb\xbf" if k == 4 else b"") + text.encode("utf-8", "surrogatepass"))
        found = items if shape < 2 else [whole]
        want[f"f{k}.json"] = [x for x in found if isinstance(x, dict)]
    got = {}
    for r in splitjson.read_objects(spark, str(tmp_path)).orderBy("file", "pos").collect():
        got.setdefault(r.file.split("/")[-1], []).append(json.loads(r.json))
    assert got == {k: v for k, v in want.items() if v}


def test_broken_files(spark, tmp_path):
    for name, text in (("a.json", '[{"a": 1}, {"b": '), ("b.json", '[{"a": "x}]'), ("c.json", '[{"a": 1}]'), ("d.json", ""), ("e.json", " \n")):
        (tmp_path / name).write_text(text)
    with pytest.raises(splitjson.BrokenExport, match="a.json|b.json"):
        splitjson.read_objects(spark, str(tmp_path))
    assert [r.json for r in splitjson.read_objects(spark, str(tmp_path), strict=False).collect()] == ['{"a": 1}']


def tree(text, title="T"):
    return {"title": title, "create_time": 1.0, "current_node": "n", "mapping": {"n": {"id": "n", "parent": None, "children": [], "message": {"author": {"role": "user"}, "content": {"parts": [text]}}}}}


def listed(text):
    return {"name": "N", "created_at": "2026-01-01T00:00:00Z", "chat_messages": [{"sender": "human", "text": text}]}


def test_first_record_decides(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([3, tree("one"), {"foo": 1}, listed("two"), tree("three")]))
    (tmp_path / "b.json").write_text(json.dumps({"conversations": [listed("four"), {"foo": 1}]}))
    convos = exports.read_exports(spark, str(tmp_path))
    assert sorted(r.text for r in exports.parse_exports(convos, NOW).collect()) == ["four", "one", "three"]
    assert sorted((r.format, r.n, r.n_odd) for r in exports.formats(convos).collect()) == [("chatgpt", 4, 2), ("claude", 2, 1)]
    (tmp_path / "c.json").write_text(json.dumps([{"foo": 1}, tree("five")]))
    with pytest.raises(exports.UnknownExport, match="c.json"):
        exports.parse_exports(exports.read_exports(spark, str(tmp_path)), NOW)


def test_export_folder_of_a_provider(spark, tmp_path):
    (tmp_path / "conversations.json").write_text(json.dumps([tree("kept")]))
    (tmp_path / "user.json").write_text('{"id": 1}')
    (tmp_path / "chat.html").write_text("<html>{}</html>")
    assert [r.text for r in exports.parse_exports(exports.read_exports(spark, str(tmp_path)), NOW).collect()] == ["kept"]


def test_large_export(spark, tmp_path):
    """140 MB without a line break: over what one VARIANT or one row could take."""
    n = 1400
    with open(tmp_path / "large.json", "w") as f:
        for i in range(n):
            f.write(("[" if i == 0 else ",") + json.dumps(tree(f"{i} " + "some words } of text \" here " * 3700, f"t{i}")))
        f.write("]")
    convos = exports.read_exports(spark, str(tmp_path / "large.json"))
    assert sorted(int(r.project[1:]) for r in exports.parse_exports(convos, NOW).select("project").collect()) == list(range(n))
