"""op13: all conversations damaged by the contract's rule, then repaired."""
from __future__ import annotations

import hashlib

from . import repair
from .catalog import register
from .common import join_keys, table

NOTHING = hashlib.sha256(b"").hexdigest()


@register("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    """Faults, cheapest edits and the digest of the repaired rows per conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    per, _, lines = repair.repair(repair.damaged(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = join_keys(rows.select("conv_id").distinct(), per, ["conv_id"], [*counts, "audit"], "left")
    out = join_keys(out, repair.digests(lines), ["conv_id"], ["repaired_sha256"], "left")
    return out.selectExpr("conv_id", *[f"coalesce({c}, 0) as {c}" for c in counts], "coalesce(audit, '') as audit",
                          f"coalesce(repaired_sha256, '{NOTHING}') as repaired_sha256")
