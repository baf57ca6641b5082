"""The store: one DataFrame per table under explicit schemas, and its versions on disk.

A step takes a store and returns a store. A version is published by writing its tables beside
the old ones and then moving one small manifest into place, so readers see all of a step or
nothing of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

SCHEMAS = {
    "nodes": "id long, signature string, memory_id string, class string, salience string, strength double, reactivations long, first_seen timestamp, last_reactivated timestamp, last_decayed timestamp, source_day date, notes string, forms array<string>, fact string, kind string, temporal_form string, memory_family string, salience_score double, ingested_seq long, dirty_seq long, vagueness double",
    "edges": "src string, rel string, dst string, weight double, first_seen timestamp, last_reinforced timestamp",
    "vectors": "id long, lane string, embedding array<float>",
    "meta": "key string, value string",
    "tombstones": "signature string, memory_id string, forgotten_at timestamp, reason string",
    "journal": "dreamed_at timestamp, run_id string, op string, memory_id string, signature string, category string, original_fact string, result_fact string, reason string",
    "detail_of": "detail_sig string, gist_sig string, first_seen timestamp",
    "evidence_transitions": "src_sig string, rel string, dst_sig string, first_seen timestamp, last_reinforced timestamp",
    "chronicles": "node_sig string, resolution string, period_start date, period_end date, version long, compression_level long, covered_event_count long, omitted_event_count long, latest_event_day date, coverage_seq long, created_at timestamp",
    "chronicle_entries": "chronicle_sig string, ordinal long, slot_label string, summary string, change_kind string, state_label string, aspect string",
    "chronicle_entry_entities": "chronicle_sig string, entry_ordinal long, entity_sig string",
    "chronicle_evidence": "chronicle_sig string, entry_ordinal long, evidence_sig string",
    "gist_landmarks": "gist_sig string, role string, ordinal long, evidence_sig string",
    "entity_adjudications": "sig string, status string, action string, retyped_to string, reviewed_at timestamp, reviewed_seq long, report_id string",
    "reactivation_families": "family_key string, evidence_seq long, evidence_count long, observed_at timestamp",
    "reactivation_members": "family_key string, member_sig string, evidence_count long, latest_seq long, observed_at timestamp",
    "reactivation_examples": "family_key string, new_sig string, old_sig string, observed_seq long, observed_at timestamp",
    "chains": "signature string, chain string",
    "reactivation_reviews": "family_key string, decision string, gist_sigs array<string>, reviewed_seq long, reviewed_count long, reviewed_at timestamp, report_id string",
}
LANES = ("active", "archive", "chron", "chron_archive")


def active(notes: Column | None = None, kind: Column | None = None) -> Column:
    """Facts that take part in nightly work and in retrieval; no note counts as active."""
    notes = F.col("notes") if notes is None else notes
    kind = F.col("kind") if kind is None else kind
    return (kind == "fact") & (notes.isNull() | (notes != "archive"))


def not_cold(notes: Column | None = None) -> Column:
    notes = F.col("notes") if notes is None else notes
    return notes.isNull() | ~notes.isin("detail", "archive")


def is_gist(notes: Column | None = None) -> Column:
    notes = F.col("notes") if notes is None else notes
    return F.coalesce(notes.rlike(r"\bgist\b"), F.lit(False))


def dirty(cursor: int | None, upto: int | None = None) -> Column:
    """Rows changed since a cursor; without one, all."""
    seq = F.coalesce(F.col("dirty_seq"), F.lit(0))
    out = F.lit(True) if cursor is None else seq > cursor
    return out if upto is None else out & (seq <= upto)


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` under a table's schema: missing columns become null (a migration), others are cast, further ones go."""
    schema = T._parse_datatype_string(SCHEMAS[name]) if hasattr(T, "_parse_datatype_string") else df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], SCHEMAS[name])

    def having(self, **tables: DataFrame) -> Store:
        return replace(self, tables=self.tables | {k: conform(v, k) for k, v in tables.items()})

    def facts(self) -> DataFrame:
        return self["nodes"].filter(active())

    def cursor(self, key: str) -> int | None:
        row = self["meta"].filter(F.col("key") == key).select(F.max("value")).first()
        return None if row[0] is None else int(row[0])

    def moved(self, **cursors: int) -> Store:
        """With the cursors set."""
        new = self.spark.createDataFrame([(k, str(v)) for k, v in cursors.items()], SCHEMAS["meta"])
        return self.having(meta=self["meta"].join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_manifest(spark: SparkSession, root: str) -> dict:
    p, fs = _fs(spark, f"{root}/manifest.json")
    if not fs.exists(p):
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/manifest.json").collect()))


def load(spark: SparkSession, root: str) -> Store:
    """The published version; an empty store if there is none yet."""
    tables = _read_manifest(spark, root).get("tables", {})
    return Store(spark, {n: conform(spark.read.parquet(f"{root}/{path}"), n) for n, path in tables.items()})


def publish(store: Store, root: str, run_id: str, rules: dict[str, Callable[[Store], DataFrame]] | None = None) -> bool:
    """Write a version and make it the current one; False (and nothing written) if this run was published before.

    ``rules`` give the rows that break them; any row stops the publication.
    """
    spark = store.spark
    manifest = _read_manifest(spark, root)
    if run_id in manifest.get("runs", []):
        return False
    for name, rule in (rules or {}).items():
        if not rule(store).isEmpty():
            raise ValueError(f"the store breaks the rule {name}")
    version = manifest.get("version", 0) + 1
    tables = {}
    for name, df in store.tables.items():
        tables[name] = f"v{version:08d}/{name}"
        df.write.mode("overwrite").parquet(f"{root}/{tables[name]}")
    new = {"version": version, "tables": manifest.get("tables", {}) | tables, "runs": [*manifest.get("runs", []), run_id][-1000:]}
    spare, fs = _fs(spark, f"{root}/manifest.json.{version}")
    out = fs.create(spare, True)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    final, _ = _fs(spark, f"{root}/manifest.json")
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(spare, final):
        raise OSError("the manifest couldn't be moved into place")
    return True


def _without(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(F.col(key).alias(column)), column, "left_anti")


#: What a published store must hold; each gives the rows that don't.
RULES: dict[str, Callable[[Store], DataFrame]] = {
    "entries have a chronicle": lambda s: _without(s["chronicle_entries"], "chronicle_sig", s["chronicles"], "node_sig"),
    "facets have an entry": lambda s: s["chronicle_entry_entities"].join(s["chronicle_entries"].select("chronicle_sig", F.col("ordinal").alias("entry_ordinal")), ["chronicle_sig", "entry_ordinal"], "left_anti"),
    "facets have an entity": lambda s: _without(s["chronicle_entry_entities"], "entity_sig", s["nodes"], "signature"),
    "evidence has a node": lambda s: _without(s["chronicle_evidence"], "evidence_sig", s["nodes"], "signature"),
    "memory ids are unique": lambda s: s["nodes"].filter("memory_id <> ''").groupBy("memory_id").count().filter("count > 1"),
    "edges are unique": lambda s: s["edges"].groupBy("src", F.coalesce("rel", F.lit("")), "dst").count().filter("count > 1"),
}
