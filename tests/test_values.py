"""Ids and fingerprints that SQL does not express, worked out in Python."""

import hashlib
import json
import uuid

from ledgerlark.functions import keys
from ledgerlark.plans import registered
from ledgerlark.sources import sinks

QUERIES, _ = registered()


def test_uuid5(spark, sf_dir):
    names = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    found = {r.n_nationkey: r.id for r in QUERIES["key_uuid5"](spark, sf_dir).collect()}
    assert found == {k: str(uuid.uuid5(uuid.NAMESPACE_DNS, name)) for k, name in names.items()}
    odd = spark.createDataFrame([("",), ("Ünï 漢字",)], "name string").select("name", keys.uuid5(str(uuid.NAMESPACE_DNS), keys.F.col("name")).alias("id"))
    assert all(r.id == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.name)) for r in odd.select(odd["name"], "id").toDF("name", "id").collect())


def fingerprint(rows):
    """The digest of the sums of the rows' digests, eight 32-bit words each; a row is canonical JSON with its values as text."""
    sums = [0] * 8
    for row in rows:
        digest = hashlib.sha256(json.dumps({k: None if v is None else str(v) for k, v in row.items()}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        sums = [s + int(digest[8 * i : 8 * i + 8], 16) for i, s in enumerate(sums)]
    return hashlib.sha256("|".join(map(str, sums)).encode()).hexdigest()


def test_fingerprint_of_an_export(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = [r.asDict() for r in nation.collect()]
    (found,) = QUERIES["snk7_export_fingerprint"](spark, sf_dir).collect()
    assert (found.n, found.fingerprint) == (len(rows), fingerprint(rows))
    assert sinks.set_fingerprint(nation.orderBy("n_name").repartition(7)).first().fingerprint == found.fingerprint
    assert sinks.set_fingerprint(nation.unionByName(nation.limit(1))).first().fingerprint != found.fingerprint
    odd = [{"a": None, "b": "é\n"}, {"a": 1, "b": None}]
    assert sinks.set_fingerprint(spark.createDataFrame([tuple(r.values()) for r in odd], "a long, b string")).first().fingerprint == fingerprint(odd)
    assert sinks.set_fingerprint(nation.limit(0)).first().fingerprint == fingerprint([])
