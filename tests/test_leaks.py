"""Secrets looked up in texts, against plain containment."""

import numpy as np
import pytest

from turnstone.functions import redact
from turnstone.operators import leaks

SECRETS = ["hunter22", "é€x", "a", "zz", "sk-proj-LEAKED1234567890abcdefghijklmnop", "-----BEGIN KEY-----\nAAAA" + "b" * 90, "-----BEGIN KEY-----\nCCCC" + "d" * 90, "hunter22", "", None, "longer than any text" * 9]
TEXTS = [
    (1, "my hunter22 and hunter22"), (1, "my hunter22 and hunter22"), (2, "Hunter22 é€x"), (3, None), (4, ""), (None, "zz top"), (5, "x" + SECRETS[4] + "y"), (6, SECRETS[5] + SECRETS[6]),
    (7, "-----BEGIN KEY-----\nCCCC" + "d" * 89), (8, "q"),
]


def plain(texts, secrets):
    return sorted(((k, s) for k, t in texts for s in {s for s in secrets if s} if t and s in t), key=repr)


@pytest.mark.parametrize("sent", [leaks.SENT, 0])
def test_search_equals_containment(spark, monkeypatch, sent):
    monkeypatch.setattr(leaks, "SENT", sent)
    texts = spark.createDataFrame([(k, t, "x", "y") for k, t in TEXTS], "id long, text string, secret string, hash string")
    found = leaks.search(texts, spark.createDataFrame([(s, 1) for s in SECRETS], "secret string, id int"))
    assert found.columns == ["id", "secret"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(TEXTS, SECRETS)


def test_secrets_across_slices(spark, monkeypatch):
    secret = "".join(chr(97 + i * i % 26) for i in range(41))
    rows = [(at, "." * at + secret + "." * 5) for at in (0, leaks.SLICE - 41, leaks.SLICE - 20, leaks.SLICE - 1, leaks.SLICE, 2 * leaks.SLICE - 25)] + [(-1, "." * 3 * leaks.SLICE + secret[:-1])]
    found = leaks.search(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(secret,)], "secret string"))
    assert sorted(r.id for r in found.collect()) == sorted(k for k, _ in rows if k >= 0)


def test_empty_tables(spark):
    texts, none = spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame([], "secret string")
    assert leaks.search(texts, none).collect() == []
    assert leaks.search(texts.limit(0), spark.createDataFrame([("a",)], "secret string")).collect() == []


def test_hashes_tell_windows_apart():
    data = np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint8)
    for width, hashes in leaks.window_hashes(data):
        windows = [data[i : i + width].tobytes() for i in range(len(data) - width + 1)]
        assert len(hashes) == len(windows) and len(set(zip(windows, hashes.tolist()))) == len(set(windows)) == len(set(hashes.tolist()))


def test_redaction_off_leaks_and_on_does_not(spark):
    said = [(1, "use my key sk-proj-LEAKED1234567890abcdefghijklmnop and call"), (2, "postgres://me:s3cretpw@db/x"), (3, "nothing here")]
    rows = spark.createDataFrame(said, "id long, text string")
    secrets = redact.secrets(rows)
    assert sorted(r.secret for r in secrets.collect()) == ["s3cretpw", "sk-proj-LEAKED1234567890abcdefghijklmnop"]
    assert sorted(r.id for r in leaks.search(rows, secrets).collect()) == [1, 2]
    assert leaks.search(rows.withColumn("text", redact.redact(rows.text)), secrets).collect() == []
