"""Command line: ``python -m vellumdex ingest | search | vsearch | query | eval | collection | context | status``."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from vellumdex.functions.providers import resolve_embedder, resolve_reranker
from vellumdex.functions.text import query_text
from vellumdex.plans.engine import Engine
from vellumdex.session import build_session
from vellumdex.sources.registry import Registry, read_golden

DEFAULT_INDEX, DEFAULT_REGISTRY = "data_index/index.tables", "data_index/collections.yml"


def _engine(args: argparse.Namespace, embed: bool = True) -> Engine:
    registry = Registry.load(args.collections_path)
    chosen = registry.one(args.collection) if getattr(args, "collection", None) else None
    index = args.db_path or (chosen.paths()[0] if chosen else DEFAULT_INDEX)
    runtime = resolve_embedder(args.embedding, args.model) if embed else None
    return Engine(build_session(), str(Path(index).absolute()) if "://" not in index else index, registry, runtime)


# The wording of reports in this module, which scripts read.


def cmd_ingest(args) -> None:
    engine = _engine(args)
    chosen = engine.registry.one(args.collection) if args.collection else None
    if chosen:
        engine.registry.set_paths(chosen.collection_id, engine.store.root, args.faiss_path or chosen.paths()[1])
    r = engine.ingest(chosen.root_path if chosen else args.source, args.collection, args.rebuild)
    print(f"Ingest complete: docs={r.documents}, chunks={r.chunks}, dim={r.embedding_dim}")
    print(f"Embedding: provider={r.embedding_provider}, model={r.embedding_model}")
    print(f"Collection: {r.collection_name} ({r.collection_id})")
    print(f"Delta: updated_docs={r.updated_documents}, deleted_docs={r.deleted_documents}, new_embeddings={r.new_embedding_hashes}, reused_embeddings={r.reused_embedding_hashes}")
    print(f"Source: {r.source}\nIndex: {engine.store.root}")


def cmd_search(args) -> None:
    if not query_text(args.query):
        print("[]")
        return
    engine = _engine(args, args.mode != "fulltext")
    reranker = resolve_reranker(args.reranker_provider, args.reranker_model, args.reranker_device, own_process=args.reranker_process) if getattr(args, "use_reranker", False) else None
    found = engine.search(args.query, args.mode, args.top_k, collection=args.collection, reranker=reranker, rerank_top_k=getattr(args, "rerank_top_k", 20))
    print(engine.payload(found, args.show_chunk_type))


def cmd_eval(args) -> None:
    total, details = _engine(args).evaluate(read_golden(args.golden), args.collection)
    t = total.first()
    print(f"Queries: {t['queries']}\nrecall@5: {t['recall_at_5']:.4f}\nMRR@10: {t['mrr_at_10']:.4f}\nnDCG@10: {t['ndcg_at_10']:.4f}")
    if args.verbose:
        for r in details.orderBy("query_id").collect():
            print(f"- {r['query']}: recall@5={r['recall_at_5']:.4f} rr@10={r['rr_at_10']:.4f} ndcg@10={r['ndcg_at_10']:.4f}")
            print(f"  expected: {', '.join(r['relevant_docs'])}\n  top results: {', '.join(r['top_results'] or [])}")


def cmd_collection(args) -> None:
    registry = Registry.load(args.collections_path)
    if args.action == "add":
        c = registry.add(args.name, args.root_path, mask=args.mask, include_by_default=args.include_by_default, db_path=args.db_path, faiss_path=args.faiss_path)
        print(f"Added collection: {c.name} ({c.collection_id})")
    elif args.action == "rename":
        print(f"Renamed collection: {registry.rename(args.target, args.new_name).name}")
    elif args.action == "remove":
        print(f"Removed collection: {registry.remove(args.target).name}")
    else:
        for c in registry.listed():
            print(f"- {c.name} ({c.collection_id}) root={c.root_path} mask={c.mask} default={c.include_by_default}")
        if not registry.collections:
            print("No collections.")


def cmd_context(args) -> None:
    registry = Registry.load(args.collections_path)
    label = lambda x: "/" if x.collection_id is None else registry.uri(x.collection_id, x.path_prefix)
    if args.action == "add":
        text = args.text if args.text is not None else Path(args.file).read_text("utf-8")
        print(f"Saved context: {label(registry.put_context(args.target, text))}")
    elif args.action == "rm":
        print(f"Removed context: {label(registry.drop_context(args.target))}")
    else:
        for x in registry.contexts_at(args.target):
            flat = " ".join(x.text.split())
            print(f"- {label(x)}: {flat if len(flat) <= 180 else flat[:177] + '...'}")


def cmd_status(args) -> None:
    engine = _engine(args, False)
    if not engine.registry.collections:
        print("No collections.")
        return
    rows = engine.status().collect()
    print(f"Total: collections={len(rows)} embedded_files={sum(r['documents'] for r in rows)} chunks={sum(r['chunks'] for r in rows)}")
    for r in rows:
        print(f"- {r['name']} ({r['collection_id']}) embedded_files={r['documents']} chunks={r['chunks']} last_ingested_at={r['last_ingested_at'] or '-'}")


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="vellumdex")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, embed: bool = False, index: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--collections-path", default=os.environ.get("VELLUMDEX_COLLECTIONS", DEFAULT_REGISTRY))
        if index:
            p.add_argument("--db-path")
            p.add_argument("--faiss-path", help="where the collection keeps its vectors; kept in the registry, the index itself holds them as a table")
            p.add_argument("--collection")
        if embed:
            p.add_argument("--embedding", choices=["hash", "local", "remote"], default="hash")
            p.add_argument("--model")
        return p

    p = command("ingest", cmd_ingest, True)
    p.add_argument("--source", default=os.environ.get("VELLUMDEX_SOURCE", "."))
    p.add_argument("--rebuild", action="store_true")
    for name, mode in (("search", "fulltext"), ("vsearch", "vector"), ("query", "hybrid")):
        p = command(name, cmd_search, mode != "fulltext")
        p.set_defaults(mode=mode)
        p.add_argument("query")
        p.add_argument("--top-k", type=int, default=20)
        p.add_argument("--show-chunk-type", action="store_true")
        if mode == "hybrid":
            p.add_argument("--use-reranker", action="store_true")
            p.add_argument("--reranker-provider", choices=["local", "cohere", "openrouter"], default="local")
            p.add_argument("--reranker-model")
            p.add_argument("--rerank-top-k", type=int, default=20)
            p.add_argument("--reranker-process", action="store_true", help="run a local model in a process of its own")
            p.add_argument("--reranker-device", choices=["auto", "mps", "cpu"], default="auto")
    p = command("eval", cmd_eval, True)
    p.add_argument("--golden", default="tests/golden.yaml")
    p.add_argument("--verbose", action="store_true")
    p = command("collection", cmd_collection, index=False)
    actions = p.add_subparsers(dest="action", required=True)
    a = actions.add_parser("add")
    a.add_argument("name")
    a.add_argument("root_path")
    a.add_argument("--db-path")
    a.add_argument("--faiss-path")
    a.add_argument("--mask", default="*.md")
    a.add_argument("--include-by-default", action=argparse.BooleanOptionalAction, default=True)
    actions.add_parser("list")
    a = actions.add_parser("rename")
    a.add_argument("target")
    a.add_argument("new_name")
    actions.add_parser("remove").add_argument("target")
    p = command("context", cmd_context, index=False)
    actions = p.add_subparsers(dest="action", required=True)
    a = actions.add_parser("add")
    a.add_argument("target")
    group = a.add_mutually_exclusive_group(required=True)
    group.add_argument("--text")
    group.add_argument("--file")
    actions.add_parser("list").add_argument("target", nargs="?")
    actions.add_parser("rm").add_argument("target")
    command("status", cmd_status)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    args.run(args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
