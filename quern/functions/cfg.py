"""Control-flow structure of a byte program: blocks, jumps, reachability, compaction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import opcodes
from quern.functions.bytecode import _decode
from quern.schemas import struct

_LOOKS_AT_CODE = frozenset({"CODESIZE", "CODECOPY"})


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges in order, those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def split_trailer(code: bytes) -> int:
    """Where the metadata trailer begins: the length without one."""
    if len(code) < 4:
        return len(code)
    start = len(code) - 2 - int.from_bytes(code[-2:], "big")
    return start if 0 <= start < len(code) - 2 and code[start] == 0xA2 else len(code)


def analyse(code: bytes) -> dict:
    """Reachable part of a program.

    A jump is resolved only where the instruction before it is a PUSH1 to PUSH32
    of a JUMPDEST's place; any other may go to every JUMPDEST. A program that
    reads its own code keeps everything, since removing bytes would change what
    it reads. Besides the reachable code there are the code without trailer, the
    prefix up to the first STOP and what follows that.
    """
    end = split_trailer(code)
    body = code[:end]
    ins = _decode(body)
    starts = {0} if ins else set()
    for k, (pc, size, _, token, _) in enumerate(ins):
        if token == "JUMPDEST":
            starts.add(pc)
        if (token in opcodes.TERMINATORS or token == "JUMPI") and k + 1 < len(ins):
            starts.add(ins[k + 1][0])
    order = sorted(starts)
    blocks: dict[int, list] = {s: [] for s in order}
    at = -1
    for x in ins:
        if x[0] in blocks:
            at = x[0]
        blocks[at].append(x)
    dests = {x[0] for x in ins if x[3] == "JUMPDEST"}
    after = dict(zip(order, order[1:]))
    seen, todo, unresolved = set(), order[:1], 0
    while todo:
        b = todo.pop()
        if b in seen:
            continue
        seen.add(b)
        last = blocks[b][-1]
        nexts: list[int] = []
        if last[3] in ("JUMP", "JUMPI"):
            before = blocks[b][-2] if len(blocks[b]) > 1 else None
            target = int(before[4], 16) if before and before[3] == "PUSH" and before[4] else None
            if target in dests:
                nexts.append(target)
            else:
                unresolved += 1
                nexts += dests
        if last[3] not in opcodes.TERMINATORS and b in after:
            nexts.append(after[b])
        todo += nexts
    introspects = any(x[3] in _LOOKS_AT_CODE for b in seen for x in blocks[b])
    kept = set(order) if introspects else seen
    size = {b: sum(x[1] for x in blocks[b]) for b in order}
    gone = merge_ranges([(b, b + size[b]) for b in order if b not in kept])
    compact = b"".join(body[b : b + size[b]] for b in order if b in kept)
    masked = bytearray(body)
    for a, z in gone:
        masked[a:z] = b"\x00" * (z - a)
    stop = next((x[0] for x in ins if x[3] == "STOP"), None)
    beyond = stop is not None and any(b > stop for b in seen)
    return {
        "blocks": len(order),
        "reachable_blocks": len(seen),
        "unresolved_jumps": unresolved,
        "introspects": introspects,
        "reachable_after_stop": beyond,
        "executable_bytes": end,
        "trailer": code[end:].hex(),
        "removed_bytes": sum(z - a for a, z in gone),
        "removed": [{"start": a, "end": z} for a, z in gone],
        "compact": compact.hex(),
        "masked": bytes(masked).hex(),
        "stripped": body.hex(),
        "prefix": (body if stop is None else body[: stop + 1]).hex(),
        "suffix": (b"" if stop is None else body[stop + 1 :]).hex(),
    }


_RESULT = struct(
    "blocks int, reachable_blocks int, unresolved_jumps int, introspects boolean, reachable_after_stop boolean, executable_bytes int, trailer string, removed_bytes int"
)
_RESULT = _RESULT.add("removed", T.ArrayType(struct("start int, end int"))).add("compact", "string").add("masked", "string").add("stripped", "string").add("prefix", "string").add("suffix", "string")


@F.pandas_udf(_RESULT)
def control_flow(code: pd.Series) -> pd.DataFrame:
    """``analyse`` of each byte string; null as empty. A row's graph is its own, so rows stay independent."""
    return pd.DataFrame([analyse(bytes(c) if c is not None else b"") for c in code])


#: What ``control_flow`` counts, without the texts of a program's representations.
COUNTS = ("blocks", "reachable_blocks", "unresolved_jumps", "introspects", "executable_bytes", "removed_bytes")


@F.pandas_udf(T.StructType([_RESULT[n] for n in COUNTS]))
def control_flow_counts(code: pd.Series) -> pd.DataFrame:
    """The counts of ``analyse`` alone: a batch holds no texts several times as long as its programs."""

    def counts(c: bytes | None) -> tuple:
        found = analyse(bytes(c) if c is not None else b"")
        return tuple(found[n] for n in COUNTS)

    return pd.DataFrame(list(map(counts, code)), columns=list(COUNTS))
