"""Write the formatted physical plans of selected queries to PLANS.md
(expression lines are truncated; the operator tree is what matters)."""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kbweave.config import get_session  # noqa: E402
from kbweave.plans import catalog  # noqa: E402

NAMES = ["topk_batch", "topk_text", "hash_embed", "kb_documents", "kb_atomic", "history_window",
         "session_truncate", "intent_classify", "dialog_answers"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    out = ["# Physical plans (sf0.01, local[8], AQE initial plans)\n"]
    for n in NAMES:
        df = catalog.QUERIES[n](spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        lines = [ln if len(ln) <= 240 else ln[:240] + " ..." for ln in buf.getvalue().splitlines()]
        out.append(f"## {n}\n\n```\n" + "\n".join(lines) + "\n```\n")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
