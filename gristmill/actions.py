"""The operators by the name of the action that a record store or knowledge base is asked for."""

from __future__ import annotations

from collections.abc import Callable

from .operators import graph, kb, listing, packs, recall, search, store
from .sources import packages
from .streaming import ledger

ACTIONS: dict[str, Callable] = {
    "read": recall.admit, "add": store.add_entry, "replace": store.replace_entry, "remove": store.remove_entry, "log": ledger.append_ledger, "status": listing.status_report, "sunk": store.newest,
    "link": packs.upsert_links, "unlink": graph.pruned, "related": graph.expanded, "entities": store.mentions, "kb-ingest": packs.ingest, "kb-search": kb.find, "kb-list": listing.latest, "kb-read": search.bounded_read,
    "kb-drop": packs.drop_documents, "export": packs.export_pack, "import": packs.import_pack, "migrate": packages.sqlite_rows,
}


def act(name: str, *args, **options):
    """Runs an action; one that does not exist is an error."""
    if name not in ACTIONS:
        raise ValueError(f"no such action: {name}")
    return ACTIONS[name](*args, **options)
