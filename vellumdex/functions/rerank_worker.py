"""The process of ``SubprocessReranker``: one JSON request on standard input, the scores as JSON on standard output."""

from __future__ import annotations

import json
import sys

from vellumdex.functions.providers import INSTRUCTION, LOCAL_RERANKER, ProviderError, TransformersReranker


def main() -> int:
    try:
        asked = json.load(sys.stdin)
        reranker = TransformersReranker(str(asked.get("model") or LOCAL_RERANKER), str(asked.get("device", "auto")), int(asked.get("max_length", 8192)), str(asked.get("instruction") or INSTRUCTION))
        scores = reranker.score(str(asked["query"]), [str(d) for d in asked.get("documents", [])])
    except (ProviderError, KeyError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    json.dump({"scores": scores}, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
