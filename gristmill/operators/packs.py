"""Documents that come and go, and packs of whole stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import pruned
from .kb import self_consistent
from .listing import live_ids
from .search import strictest
from .store import append_new


def ingest(manifest: DataFrame, fresh: DataFrame) -> dict[str, DataFrame]:
    """Documents by path: an equal hash changes nothing but the tier, another hash replaces, an unknown path is added.

    Returns the new ``manifest``, a ``report`` (id, action) and the ``dead`` ids: of
    chunks that no document holds any more.  The document's own id lives on.
    """
    old, new = manifest.alias("o"), fresh.alias("n")
    both = old.join(new, F.col("o.id") == F.col("n.id"), "full")
    same = F.col("o.hash") == F.col("n.hash")
    action = F.when(F.col("n.id").isNull(), "kept").when(F.col("o.id").isNull(), "added").when(same & (F.col("o.tier") != F.col("n.tier")), "retiered").when(same, "unchanged").otherwise("replaced")
    take_old = action.isin("kept", "unchanged", "retiered")
    rows = both.select(*((F.when(action == "retiered", F.col("n.tier")).when(take_old, F.col("o.tier")).otherwise(F.col("n.tier")) if c == "tier" else F.when(take_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c) for c in manifest.columns), action.alias("action"))
    kept = rows.drop("action")
    none = manifest.select("id").limit(0)
    dead = live_ids(none, manifest).join(live_ids(none, kept), "id", "left_anti")
    return {"manifest": kept, "report": rows.select("id", "action").filter("action <> 'kept'"), "dead": dead}


def drop_documents(manifest: DataFrame, gone: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Without some documents: the manifest, the ids that died (chunks shared with others live on) and the edges left."""
    kept = manifest.join(gone.select("id"), "id", "left_anti")
    none = manifest.select("id").limit(0)
    dead = live_ids(none, manifest).join(live_ids(none, kept), "id", "left_anti")
    return {"manifest": kept, "dead": dead, "edges": pruned(edges, dead.select(F.col("id").alias("node")))}


def export_pack(stores: dict[str, DataFrame], path: str) -> None:
    """Every store as JSON lines in a folder of its own."""
    for name, df in stores.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def import_entries(known: DataFrame, pack: DataFrame, tombstones: DataFrame) -> dict[str, DataFrame]:
    """Entries of a pack that are new by id and by trimmed content and not dead; the report counts each reason."""
    dead = tombstones.select("id", F.lit(True).alias("_dead")).distinct()
    ids = known.select("id", F.lit(True).alias("_known")).distinct()
    texts = known.select(F.trim("content").alias("_text"), F.lit(True).alias("_same")).distinct()
    rows = pack.dropDuplicates(["id"]).withColumn("_text", F.trim("content")).join(dead, "id", "left").join(ids, "id", "left").join(texts, "_text", "left")
    rows = rows.withColumn("reason", F.when(F.col("_dead"), "dead").when(F.col("_known"), "known").when(F.col("_same"), "same content").otherwise("added"))
    return {"entries": known.unionByName(rows.filter("reason = 'added'").select(known.columns)), "report": rows.groupBy("reason").agg(F.count("*").alias("n"))}


def import_tiers(known: DataFrame, pack: DataFrame) -> DataFrame:
    """(id, tier): of two stores that disagree the stricter one counts."""
    return known.select("id", "tier").unionByName(pack.select("id", "tier")).groupBy("id").agg(strictest(F.col("tier")).alias("tier"))


def upsert_links(edges: DataFrame, more: DataFrame) -> DataFrame:
    """By source, target and kind: a known edge takes the conflict's class and state, a new one is added; no self-loops."""
    key = ["src", "dst", "kind"]
    fresh = more.filter("src <> dst").dropDuplicates(key)
    changed = fresh.select(*key, F.col("conflict_class").alias("_class"), F.col("conflict_state").alias("_state"))
    old = edges.join(changed, key, "left").select(*key, F.coalesce("_class", "conflict_class").alias("conflict_class"), F.coalesce("_state", "conflict_state").alias("conflict_state"))
    return old.unionByName(fresh.join(edges.select(key), key, "left_anti").select(*key, "conflict_class", "conflict_state"))


def import_pack(known: dict[str, DataFrame], pack: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(stores, report) after a pack is taken in, a repeat changing nothing.

    In this order: tiers (the stricter of two counts), entries (new by id and content, not
    dead), ledger and tombstones (new by id), archive (new by block), kb documents and
    chunks (new by id, chunks whose text is what was stored), and links, which must not
    touch an id that is dead by then.  The report has the rows added to each store.
    """
    out = dict(known)
    out["tiers"] = import_tiers(known["tiers"], pack["tiers"])
    out["entries"] = import_entries(known["entries"], pack["entries"], known["tombstones"])["entries"]
    for name, key in (("ledger", "id"), ("tombstones", "id"), ("archive", "block_id"), ("documents", "id")):
        out[name] = append_new(known[name], pack[name], key)
    out["chunks"] = append_new(known["chunks"], pack["chunks"].filter(self_consistent(pack["chunks"])), "id")
    dead = out["tombstones"].select(F.col("id").alias("node"))
    out["links"] = upsert_links(known["links"], pruned(pack["links"], dead))
    report = None
    for name in ("tiers", "entries", "ledger", "tombstones", "archive", "documents", "chunks", "links"):
        n = lambda df: df.agg(F.count("*").alias("n"))
        row = n(out[name]).crossJoin(n(known[name]).withColumnRenamed("n", "before")).select(F.lit(name).alias("store"), (F.col("n") - F.col("before")).alias("added"))  # one row each
        report = row if report is None else report.unionByName(row)
    return out, report
