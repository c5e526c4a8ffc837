"""Queries on byte programs, which are spelt from the hash of each part's name.

A program is 24 pieces of code chosen by the digits of a sha256; some parts add
an instruction that reads code, or a metadata trailer. DuckDB spells the same
programs and walks them by a recursive query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import bytecode, features, opcodes
from quern.functions.cfg import control_flow, control_flow_counts
from quern.operators import programs, similarity
from quern.plans.registry import dealt, query, table

_PIECES = ("00", "01", "5b", "6004", "56", "57", "6010", "35", "600c", "f3", "63a9059cbb", "5f", "6110aa", "f1", "fe", "0c")
_LIST = "[" + ", ".join(f"'{p}'" for p in _PIECES) + "]"
_CODE = f"""code AS (SELECT id, array_to_string(list_transform(range(1, 25), lambda i: {_LIST}[CAST('0x' || substr(s, CAST(i AS INTEGER), 1) AS INTEGER) + 1]), '')
    || CASE WHEN id % 7 = 0 THEN '38' ELSE '' END || CASE WHEN id % 5 = 0 THEN 'a201020003' ELSE '' END AS h FROM (SELECT p_partkey AS id, sha256(p_name || p_partkey::VARCHAR) AS s FROM part))"""
_TOKENS = ["PUSH" if 0x60 <= b <= 0x7F else opcodes.table()[b][0] if b in opcodes.table() else f"UNK_{b:02x}" for b in range(256)]
_OPS = "ops(code, token, pops, pushes, gas) AS (VALUES " + ", ".join(f"({b}, '{t}', {', '.join(map(str, opcodes.table().get(b, ('', 0, 0, 0))[1:]))})" for b, t in enumerate(_TOKENS)) + ")"


def _walk(source: str = "code") -> str:
    return f"""i(id, h, pos, pc, b) AS (SELECT id, h, 0, 0, CAST('0x' || substr(h, 1, 2) AS INTEGER) FROM {source} WHERE h <> '' UNION ALL
    SELECT id, h, pos + 1, pc + st, CAST('0x' || substr(h, (pc + st) * 2 + 1, 2) AS INTEGER) FROM (SELECT *, CASE WHEN b BETWEEN 96 AND 127 THEN b - 94 ELSE 1 END AS st FROM i) WHERE (pc + st) * 2 < length(h)),
    t AS (SELECT id, h, pos, pc, CAST(least(CASE WHEN b BETWEEN 96 AND 127 THEN b - 94 ELSE 1 END, length(h) // 2 - pc) AS INTEGER) AS size, b AS code, token, pops, pushes, gas,
    CASE WHEN b BETWEEN 96 AND 127 THEN substr(h, pc * 2 + 3, (least(b - 94, length(h) // 2 - pc) - 1) * 2) END AS immediate FROM i JOIN ops ON ops.code = b)"""


_BASE = f"WITH RECURSIVE {_CODE}, {_OPS}, {_walk()}"
_HALTS = "('STOP', 'RETURN', 'REVERT', 'INVALID', 'SELFDESTRUCT')"
_ENDS = "('STOP', 'RETURN', 'REVERT', 'INVALID', 'SELFDESTRUCT', 'JUMP', 'JUMPI')"


def codes(spark, sf_dir):
    """(id, h): the program of each part. A part is a few bytes and its program many, so parts are dealt out first."""
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select(F.col("p_partkey").alias("id"), F.sha2(F.concat("p_name", F.col("p_partkey").cast("string")), 256).alias("s"))
    pieces = F.array(*map(F.lit, _PIECES))
    spelt = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.get(pieces, F.conv(F.substring("s", i, F.lit(1)), 16, 10).cast("int"))), "")
    read = F.when(F.col("id") % 7 == 0, "38").otherwise("")
    return part.select("id", F.concat(spelt, read, F.when(F.col("id") % 5 == 0, "a201020003").otherwise("")).alias("h"))


def instructions(spark, sf_dir):
    c = codes(spark, sf_dir).select("id", bytecode.to_bytes(F.col("h")).alias("c"))
    return bytecode.instructions(c, "id", "c")


def decoded(spark, sf_dir):
    c = codes(spark, sf_dir).withColumn("d", bytecode.disassemble(bytecode.to_bytes(F.col("h"))))
    return c.select("id", "h", F.col("d.ops").alias("ops"), F.col("d.push_sizes").alias("p"), F.col("d.selectors").alias("s"))


@query("program_instructions", f"{_BASE} SELECT id, pos, pc, size, code, token, immediate FROM t")
def program_instructions(spark, sf_dir):
    """Linear sweep, one row per instruction."""
    return instructions(spark, sf_dir)


@query("program_totals", f"{_BASE} SELECT id, CAST(count(*) AS INTEGER) AS n_ops, CAST(sum(pushes - pops) AS INTEGER) AS stack_balance, CAST(sum(gas) AS INTEGER) AS gas FROM t GROUP BY id")
def program_totals(spark, sf_dir):
    """Instructions, stack effect and gas of each program."""
    c = codes(spark, sf_dir).select("id", bytecode.program_totals(bytecode.to_bytes(F.col("h"))).alias("t"))
    return c.select("id", "t.*")


@query("program_stack_and_gas", f"{_BASE} SELECT id, CAST(sum(pushes - pops) AS BIGINT) AS stack_balance, CAST(sum(gas) AS BIGINT) AS gas FROM t GROUP BY id")
def program_stack_and_gas(spark, sf_dir):
    """The same from the instruction table and its dimension."""
    return bytecode.stack_and_gas(instructions(spark, sf_dir), "id")


@query("full_disassembly", f"{_BASE} SELECT id, pos, CASE WHEN code BETWEEN 96 AND 127 THEN 'PUSH' || (code - 95) ELSE token END AS name, coalesce(immediate, '') AS operand, pops, pushes, gas FROM t")
def full_disassembly(spark, sf_dir):
    """Each instruction with its own name, operand, stack effect and gas."""
    full = bytecode.full_rows(instructions(spark, sf_dir))
    return full.select("id", "pos", "name", F.coalesce("immediate", F.lit("")).alias("operand"), "pops", "pushes", "gas")


@query("program_assembled", f"WITH {_CODE} SELECT id, h AS hex FROM code")
def program_assembled(spark, sf_dir):
    """Instructions put together again."""
    return bytecode.assemble(instructions(spark, sf_dir), "id")


@query("program_addresses", f"{_BASE} SELECT id, pos, pc FROM t")
def program_addresses(spark, sf_dir):
    """Places computed again from the sizes before."""
    return programs.with_addresses(instructions(spark, sf_dir).drop("pc"), "id").select("id", "pos", "pc")


@query("push_positions", f"""{_BASE} SELECT id, pos, code - 95 AS width, pc + 1 AS "start", pc + size AS "end" FROM t WHERE token = 'PUSH'""")
def push_positions(spark, sf_dir):
    return programs.push_positions(instructions(spark, sf_dir), "id")


@query(
    "program_blocks",
    f"""{_BASE}, l AS (SELECT id, pos, token, lag(token) OVER (PARTITION BY id ORDER BY pos) AS before FROM t)
    SELECT id, pos, CAST(sum(CASE WHEN pos > 0 AND (token = 'JUMPDEST' OR coalesce(before IN {_ENDS}, FALSE)) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM l""",
)
def program_blocks(spark, sf_dir):
    """Number of each instruction's basic block."""
    return programs.block_numbers(instructions(spark, sf_dir), "id").select("id", "pos", "block")


_JUMPS = """l AS (SELECT *, lag(token) OVER w AS before, lag(immediate) OVER w AS pushed FROM t WINDOW w AS (PARTITION BY id ORDER BY pos)),
    j AS (SELECT id, pc, CAST('0x' || pushed AS BIGINT) AS target FROM l WHERE token IN ('JUMP', 'JUMPI') AND before = 'PUSH' AND pushed <> '')"""


@query("direct_jumps", f"{_BASE}, {_JUMPS} SELECT j.id, j.pc, CAST(j.target AS INTEGER) AS target FROM j JOIN t ON t.id = j.id AND t.pc = j.target AND t.token = 'JUMPDEST'")
def direct_jumps(spark, sf_dir):
    """Jumps to a JUMPDEST that is pushed just before."""
    return programs.direct_jumps(instructions(spark, sf_dir), "id")


_FLOW = f"""WITH RECURSIVE {_CODE}, {_OPS},
    cut AS (SELECT id, h, length(h) // 2 AS n, length(h) // 2 - 2 - CAST('0x' || right(h, 4) AS INTEGER) AS s FROM code),
    body AS (SELECT id, CASE WHEN n >= 4 AND s >= 0 AND s < n - 2 AND substr(h, s * 2 + 1, 2) = 'a2' THEN substr(h, 1, s * 2) ELSE h END AS h FROM cut),
    {_walk('body')}, {_JUMPS},
    k AS (SELECT *, sum(CASE WHEN pos > 0 AND (token = 'JUMPDEST' OR coalesce(before IN {_ENDS}, FALSE)) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM l),
    d AS (SELECT id, pc, block FROM k WHERE token = 'JUMPDEST'),
    e AS (SELECT id, block, sum(size) AS bytes, bool_or(token IN ('CODESIZE', 'CODECOPY')) AS reads, arg_max(token, pos) AS last, max(pc) AS at FROM k GROUP BY id, block),
    f AS (SELECT e.*, d.block AS direct FROM e LEFT JOIN j ON j.id = e.id AND j.pc = e.at AND e.last IN ('JUMP', 'JUMPI') LEFT JOIN d ON d.id = j.id AND d.pc = j.target),
    edge AS (SELECT id, block AS a, block + 1 AS b FROM f WHERE last NOT IN {_HALTS} AND last <> 'JUMP' UNION SELECT id, block, direct FROM f WHERE direct IS NOT NULL
    UNION SELECT f.id, f.block, d.block FROM f JOIN d ON d.id = f.id WHERE f.last IN ('JUMP', 'JUMPI') AND f.direct IS NULL),
    r(id, block) AS (SELECT id, block FROM e WHERE block = 0 UNION SELECT r.id, edge.b FROM r JOIN edge ON edge.id = r.id AND edge.a = r.block),
    g AS (SELECT f.*, r.block IS NOT NULL AS seen FROM f LEFT JOIN r ON r.id = f.id AND r.block = f.block)"""


@query(
    "program_reachability",
    f"""{_FLOW}
    SELECT id, CAST(count(*) AS INTEGER) AS blocks, CAST(count(*) FILTER (WHERE seen) AS INTEGER) AS reachable_blocks, CAST(count(*) FILTER (WHERE seen AND last IN ('JUMP', 'JUMPI') AND direct IS NULL) AS INTEGER) AS unresolved_jumps,
    bool_or(seen AND reads) AS introspects, CAST(sum(bytes) AS INTEGER) AS executable_bytes, CAST(CASE WHEN bool_or(seen AND reads) THEN 0 ELSE coalesce(sum(bytes) FILTER (WHERE NOT seen), 0) END AS INTEGER) AS removed_bytes FROM g GROUP BY id""",
)
def program_reachability(spark, sf_dir):
    """Blocks, reachable blocks and what may be removed of each program."""
    c = codes(spark, sf_dir).select("id", control_flow_counts(bytecode.to_bytes(F.col("h"))).alias("c"))
    return c.select("id", "c.blocks", "c.reachable_blocks", "c.unresolved_jumps", "c.introspects", "c.executable_bytes", "c.removed_bytes")


_STOP = f"{_BASE}, s AS (SELECT id, CAST(length(h) // 2 AS INTEGER) AS n, h, (SELECT min(pc) FROM t WHERE t.id = code.id AND token IN {_HALTS}) AS stop FROM code)"


@query("program_first_stop", f"{_STOP} SELECT id, coalesce(stop, -1) AS stop_offset, n AS length, substr(h, 1, 2 * coalesce(stop + 1, n)) AS prefix, coalesce(stop + 1, n) = n AS whole, coalesce(stop + 1, n) <= 2 AS near_empty FROM s")
def program_first_stop(spark, sf_dir):
    """The prefix up to the first halting instruction."""
    return codes(spark, sf_dir).select("id", bytecode.first_stop(bytecode.to_bytes(F.col("h"))).alias("f")).select("id", "f.*").withColumn("stop_offset", F.coalesce("stop_offset", F.lit(-1)))


@query("terminal_statistics", f"{_STOP} SELECT id, n - coalesce(stop + 1, n) AS trailing_bytes, round((n - coalesce(stop + 1, n)) / n, 9) AS trailing_share, n > coalesce(stop + 1, n) AS has_trailing, stop IS NULL AS no_stop FROM s")
def terminal_statistics(spark, sf_dir):
    f = codes(spark, sf_dir).select("id", bytecode.first_stop(bytecode.to_bytes(F.col("h"))).alias("f"))
    t = f.select("id", programs.terminal_statistics(F.col("f.stop_offset"), F.col("f.length")).alias("t")).select("id", "t.*")
    return t.withColumn("trailing_share", F.round("trailing_share", 9))


@query("program_selectors", f"{_BASE} SELECT id, immediate AS selector FROM t WHERE code = 99 AND length(immediate) = 8 GROUP BY ALL")
def program_selectors(spark, sf_dir):
    """Distinct four-byte selectors of each program."""
    return decoded(spark, sf_dir).select("id", F.explode("s").alias("selector"))


_COUNT = "CAST(count(*) FILTER (WHERE {}) AS DOUBLE)"
_CALLS = "token IN ('CALL', 'STATICCALL', 'DELEGATECALL', 'CALLCODE')"
_TOKEN_COUNTS = {
    "n_jumpdest": "token = 'JUMPDEST'",
    "n_jump": "token = 'JUMP'",
    "n_jumpi": "token = 'JUMPI'",
    "n_call": "token = 'CALL'",
    "n_staticcall": "token = 'STATICCALL'",
    "n_delegatecall": "token = 'DELEGATECALL'",
    "n_callcode": "token = 'CALLCODE'",
    "n_call_family": _CALLS,
    "n_create": "token IN ('CREATE', 'CREATE2')",
    "n_selfdestruct": "token = 'SELFDESTRUCT'",
    "n_sstore": "token = 'SSTORE'",
    "n_sload": "token = 'SLOAD'",
    "n_log": "token LIKE 'LOG%'",
    "n_revert": "token = 'REVERT'",
    "n_invalid": "token = 'INVALID' OR starts_with(token, 'UNK_')",
    "n_push": "token = 'PUSH'",
    "n_push4": "code = 99",
    "n_push20": "code = 115",
    "n_push32": "code = 127",
}
_HAS = {f"has_{s.split('(')[0]}": f"CAST(count(*) FILTER (WHERE code = 99 AND immediate = '{x}') > 0 AS INTEGER)::DOUBLE" for s, x in features.SELECTORS.items()}
_SENSITIVE = "count(DISTINCT immediate) FILTER (WHERE code = 99 AND immediate IN (" + ", ".join(f"'{x}'" for x in features.SENSITIVE_SELECTORS) + "))"


@query(
    "structural_features",
    f"""{_BASE} SELECT id, CAST(max(length(h)) // 2 AS DOUBLE) AS code_bytes, CAST(count(*) AS DOUBLE) AS n_ops, CAST(count(DISTINCT immediate) FILTER (WHERE code = 99 AND length(immediate) = 8) AS DOUBLE) AS n_selectors, 0.0::DOUBLE AS is_delegation_ptr,
    {', '.join(f'{_COUNT.format(w)} AS {n}' for n, w in _TOKEN_COUNTS.items())}, round(coalesce(avg(code - 95) FILTER (WHERE token = 'PUSH'), 0), 9) AS mean_push_size,
    round(count(*) FILTER (WHERE token = 'JUMPDEST') / count(*), 9) AS jumpdest_density, round(count(*) FILTER (WHERE {_CALLS}) / count(*), 9) AS call_density, round(count(*) FILTER (WHERE token = 'PUSH') / count(*), 9) AS push_density,
    CAST({_SENSITIVE} > 0 AS INTEGER)::DOUBLE AS has_sensitive_selector, CAST({_SENSITIVE} AS DOUBLE) AS n_sensitive_selectors, {', '.join(f'{x} AS {n}' for n, x in _HAS.items())} FROM t GROUP BY id""",
)
def structural_features(spark, sf_dir):
    """The 36 structural features of each program."""
    d = decoded(spark, sf_dir)
    t = features.structural(F.col("ops"), F.col("p"), F.col("s"), bytecode.code_bytes(F.col("h")), bytecode.is_pointer(F.col("h")))
    out = d.select("id", t.alias("t")).select("id", "t.*")
    return out.withColumns({n: F.round(n, 9) for n in ("mean_push_size", "jumpdest_density", "call_density", "push_density")})


_MOVES = ", ".join(f"'{x}'" for x in features.MOVEMENT_SELECTORS)


@query(
    "risk_factors",
    f"""{_BASE} SELECT id, bool_or({_CALLS}) AS external_call_surface, bool_or(token = 'SSTORE') AS state_write_surface, bool_or(token IN ('DELEGATECALL', 'CALLCODE')) AS delegate_proxy_surface,
    coalesce(bool_or(code = 99 AND immediate IN ({_MOVES})), FALSE) AS token_movement_selector_surface, coalesce(bool_or(code = 99 AND immediate = '{features.APPROVAL_SELECTOR}'), FALSE) AS approval_selector_surface,
    bool_or(token IN ('CREATE', 'CREATE2', 'SELFDESTRUCT')) AS code_lifecycle_surface FROM t GROUP BY id""",
)
def risk_factors(spark, sf_dir):
    return decoded(spark, sf_dir).select("id", features.risk_factors(F.col("ops"), F.col("s")).alias("f")).select("id", "f.*")


@query(
    "evidence",
    f"""{_BASE} SELECT id, CAST(max(length(h)) // 2 AS INTEGER) AS code_bytes, CAST(count(*) AS INTEGER) AS opcode_count, CAST(count(*) FILTER (WHERE token = 'CALL') AS INTEGER) AS calls,
    coalesce(string_agg(DISTINCT immediate, ',' ORDER BY immediate) FILTER (WHERE code = 99 AND immediate IN ({_MOVES})), '') AS moves FROM t GROUP BY id""",
)
def evidence(spark, sf_dir):
    """Sizes, counts and selectors behind the risk factors."""
    e = decoded(spark, sf_dir).select("id", features.evidence(F.col("ops"), F.col("s"), bytecode.code_bytes(F.col("h"))).alias("e"))
    return e.select("id", "e.code_bytes", "e.opcode_count", F.col("e.opcode_counts.CALL").alias("calls"), F.array_join("e.token_movement_selectors", ",").alias("moves"))


@query("token_counts", f"""{_BASE} SELECT id, {', '.join(f'''count(*) FILTER (WHERE token = '{x}') AS "{x}"''' for x in ('CALL', 'JUMP', 'JUMPDEST', 'PUSH', 'STOP'))} FROM t GROUP BY id HAVING count(*) > 0""")
def token_counts(spark, sf_dir):
    """Raw counts, a column for each token of a vocabulary."""
    return features.count_matrix(instructions(spark, sf_dir), "id", "token", ["CALL", "JUMP", "JUMPDEST", "PUSH", "STOP"])


@query(
    "interleaved_tokens",
    f"""{_BASE}, x AS (SELECT id, pos * 2 AS k, token AS v FROM t UNION ALL SELECT id, pos * 2 + 1, immediate FROM t WHERE immediate IS NOT NULL), y AS (SELECT id, list(v ORDER BY k)[1:40] AS v FROM x GROUP BY id)
    SELECT id, array_to_string(list_concat(v, list_transform(range(40 - len(v)), lambda i: '<PAD>')), ' ') AS tokens FROM y""",
)
def interleaved_tokens(spark, sf_dir):
    """Tokens and operands in turn, forty of them."""
    out = features.interleaved(instructions(spark, sf_dir), "id", "pos", "token", "immediate", 40)
    return out.select("id", F.array_join("tokens", " ").alias("tokens"))


@query(
    "lookup_image",
    f"""{_BASE}, c AS (SELECT token, count(*) AS n FROM t GROUP BY token), r AS (SELECT token, row_number() OVER (ORDER BY n, token) - 1 AS r, count(*) OVER () AS k FROM c)
    SELECT id, CAST(pos // 8 AS INTEGER) AS row, CAST(pos % 8 AS INTEGER) AS col, CAST(round_even(r * 255 / greatest(k - 1, 1), 0) AS INTEGER) AS token_code FROM t JOIN r USING (token) WHERE pos < 64""",
)
def lookup_image(spark, sf_dir):
    """Frequency codes of the first 64 tokens, placed in eight rows."""
    return features.lookup_image(instructions(spark, sf_dir), "id", "pos", ["token"], 8)


@query(
    "program_families",
    f"""{_BASE}, o AS (SELECT id, array_to_string(list(token ORDER BY pos), ' ') AS o, list_sort(list(DISTINCT immediate) FILTER (WHERE code = 99 AND length(immediate) = 8)) AS s FROM t GROUP BY id)
    SELECT id, substr(sha256(o), 1, 16) AS skeleton, CASE WHEN s IS NULL OR len(s) = 0 THEN 'NO_SELECTORS' ELSE substr(sha256(array_to_string(s, ',')), 1, 16) END AS selectors FROM o""",
)
def program_families(spark, sf_dir):
    """Families by token skeleton and by selector set."""
    return decoded(spark, sf_dir).select("id", similarity.skeleton_family(F.col("ops")).alias("skeleton"), similarity.selector_family(F.col("s")).alias("selectors"))


@query(
    "metadata_splits",
    f"""WITH {_CODE}, c AS (SELECT id, h, length(h) // 2 AS n, CAST('0x' || right(h, 4) AS INTEGER) AS size, length(h) // 2 - 2 - CAST('0x' || right(h, 4) AS INTEGER) AS s FROM code),
    k AS (SELECT *, n >= 2 AND size > 0 AND s >= 0 AND substr(h, s * 2 + 1, 2) = 'a2' AS ok FROM c)
    SELECT id, CASE WHEN ok THEN substr(h, 1, s * 2) ELSE h END AS body, CASE WHEN ok THEN substr(h, s * 2 + 1) ELSE '' END AS trailer,
    CASE WHEN ok AND n >= 4 AND s < n - 2 THEN substr(h, 1, s * 2) ELSE h END AS strict_body, contains(right(h, 300), 'a2646970667358') OR contains(right(h, 300), 'a165627a7a72305820') AS marked FROM k""",
)
def metadata_splits(spark, sf_dir):
    """Body and trailer of each program by both rules."""
    h = F.col("h")
    c = codes(spark, sf_dir).select("id", bytecode.metadata_split(h).alias("a"), bytecode.metadata_split_strict(h).alias("b"), bytecode.has_metadata(h).alias("marked"))
    return c.select("id", "a.body", "a.trailer", F.col("b.body").alias("strict_body"), "marked")


@query(
    "designators",
    f"""WITH {_CODE}, c AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'ef0100' || substr(sha256(h), 1, 40) WHEN id % 3 = 1 THEN 'ef0100' || substr(h, 1, 39) || 'x' ELSE h END AS h FROM code)
    SELECT id, starts_with(h, 'ef0100') AND length(h) = 46 AS pointer, regexp_full_match(h, 'ef0100[0-9a-f]{{40}}') AS designator, CASE WHEN regexp_full_match(h, 'ef0100[0-9a-f]{{40}}') THEN '0x' || substr(h, 7, 40) END AS target,
    regexp_full_match(h, '([0-9a-f]{{2}})+') AS valid, CASE WHEN regexp_full_match(h, '([0-9a-f]{{2}})*') THEN len(h) // 2 ELSE -1 END AS n_tokens FROM c""",
)
def designators(spark, sf_dir):
    """Pointers, designators and their targets; some texts only look like them."""
    h = F.col("h")
    look = F.when(F.col("id") % 3 == 0, F.concat(F.lit("ef0100"), F.substring(F.sha2("h", 256), 1, 40))).when(F.col("id") % 3 == 1, F.concat(F.lit("ef0100"), F.substring("h", 1, 39), F.lit("x"))).otherwise(h)
    c = codes(spark, sf_dir).select("id", look.alias("h"))
    n = F.size(bytecode.hex_tokens(h))
    return c.select("id", bytecode.is_pointer(h).alias("pointer"), bytecode.is_designator(h).alias("designator"), bytecode.designator_target(h).alias("target"), bytecode.valid_input(h).alias("valid"), F.coalesce(F.when(n >= 0, n), F.lit(-1)).cast("long").alias("n_tokens"))


@query("program_featurize")
def program_featurize(spark, sf_dir):
    """Token shares, structural features and hashed 4-grams of each program in two arrays."""
    return features.featurize(codes(spark, sf_dir), "id", "h", opcodes.vocabulary())


@query(
    "sql_push_widths",
    f"""{_BASE} SELECT id, CAST(code - 95 AS INTEGER) AS width, count(*) AS n, CAST(min(pc + 1) AS INTEGER) AS first_start, CAST(max(pc + size) AS INTEGER) AS last_end
    FROM t WHERE token = 'PUSH' GROUP BY id, code""",
)
def sql_push_widths(spark, sf_dir):
    """Written in SQL alone: immediates of each width in each program, by a lateral table function."""
    from quern.functions import sql

    sql.register(spark)
    return spark.sql(
        "SELECT id, width, count(*) AS n, min(p.start) AS first_start, max(p.end) AS last_end FROM {codes}, LATERAL push_positions(unhex(h)) p GROUP BY id, width",
        codes=codes(spark, sf_dir),
    )


@query("sql_token_counts", f"{_BASE} SELECT token, count(*) AS n, count(DISTINCT id) AS programs FROM t GROUP BY token")
def sql_token_counts(spark, sf_dir):
    """Written in SQL alone: how often each token occurs, and in how many programs."""
    from quern.functions import sql

    sql.register(spark)
    return spark.sql("SELECT token, count(*) AS n, count(DISTINCT id) AS programs FROM {codes}, LATERAL instructions(unhex(h)) GROUP BY token", codes=codes(spark, sf_dir))


_VOCABULARY = f"v AS (SELECT unnest({list(opcodes.vocabulary())}) AS token, unnest(range({len(opcodes.vocabulary())})) + 2 AS place)"
_CHUNKED = f"""{_BASE}, {_VOCABULARY},
    w AS (SELECT id, list(coalesce(place, 1) ORDER BY pos) AS ids FROM t LEFT JOIN v USING (token) GROUP BY id)"""


@query("encoded_chunks", f"{_CHUNKED} SELECT id, k AS chunk, array_to_string(list_concat(ids[k * 16 + 1:k * 16 + 16], list_transform(range(greatest(0, (k + 1) * 16 - len(ids))), lambda x: 0)), ' ') AS ids FROM (SELECT id, ids, unnest(range(CAST(ceil(len(ids) / 16.0) AS BIGINT))) AS k FROM w)")
def encoded_chunks(spark, sf_dir):
    """Token ids of each program in chunks of sixteen, the last one padded."""
    d = decoded(spark, sf_dir).select("id", features.chunked(features.encode_tokens(F.col("ops"), opcodes.vocabulary()), 16, 16).alias("c"))
    return d.select("id", F.posexplode("c").alias("k", "x")).select("id", F.col("k").cast("long").alias("chunk"), F.array_join("x", " ").alias("ids"))


@query(
    "program_views",
    f"""{_FLOW},
    x AS (SELECT id, block, string_agg(substr(h, pc * 2 + 1, size * 2), '' ORDER BY pos) AS hex FROM k GROUP BY id, block),
    y AS (SELECT id, bool_or(seen AND reads) AS whole FROM g GROUP BY id),
    z AS (SELECT g.id, string_agg(hex, '' ORDER BY block) FILTER (WHERE seen OR whole) AS compact, string_agg(CASE WHEN seen OR whole THEN hex ELSE repeat('00', CAST(bytes AS BIGINT)) END, '' ORDER BY block) AS masked
      FROM g JOIN x USING (id, block) JOIN y ON y.id = g.id GROUP BY g.id),
    o AS (SELECT id, min(pc) FILTER (WHERE token = 'STOP') AS stop FROM t GROUP BY id)
    SELECT z.id, compact, masked, body.h AS stripped, CASE WHEN stop IS NULL THEN body.h ELSE substr(body.h, 1, stop * 2 + 2) END AS prefix, CASE WHEN stop IS NULL THEN '' ELSE substr(body.h, stop * 2 + 3) END AS suffix,
      substr(code.h, length(body.h) + 1) AS trailer FROM z JOIN o USING (id) JOIN body USING (id) JOIN code USING (id)""",
)
def program_views(spark, sf_dir):
    """The representations of each program: compact, masked, stripped, prefix, suffix and what was split off."""
    c = codes(spark, sf_dir).select("id", control_flow(bytecode.to_bytes(F.col("h"))).alias("c"))
    return c.select("id", *[f"c.{n}" for n in ("compact", "masked", "stripped", "prefix", "suffix", "trailer")])


@query(
    "featurized_shares",
    f"""{_BASE}, {_VOCABULARY}, n AS (SELECT id, count(*) AS n FROM t GROUP BY id)
    SELECT t.id, place - 2 AS place, round(count(*) / any_value(n.n), 9) AS share FROM t JOIN n ON n.id = t.id JOIN v USING (token) GROUP BY t.id, place""",
)
def featurized_shares(spark, sf_dir):
    """The token shares among the features of each program, by their place in the view of that name."""
    places = features.feature_views(opcodes.vocabulary())["hist"]
    f = features.featurize(codes(spark, sf_dir), "id", "h", opcodes.vocabulary()).select("id", F.posexplode(features.view(F.col("dense"), places)).alias("place", "share"))
    return f.where("share > 0").select("id", F.col("place").cast("long").alias("place"), F.round("share", 9).alias("share"))


@query(
    "downsampled_bytes",
    f"""WITH {_CODE}, b AS (SELECT id, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(i * 2 + 1 AS INTEGER), 2) AS INTEGER)) AS b FROM code)
    SELECT id, array_to_string(CASE WHEN len(b) <= 20 THEN b ELSE list_transform(range(20), lambda i: b[i * len(b) // 20 + 1]) END, ' ') AS few,
      array_to_string(list_concat(b[1:48], list_transform(range(greatest(0, 48 - len(b))), lambda x: 0)), ' ') AS image FROM b""",
)
def downsampled_bytes(spark, sf_dir):
    """Twenty bytes of each program at a uniform stride, and its image of four by four points."""
    pixels = features.image(F.col("h"), 4)
    every = F.transform(bytecode.hex_tokens(F.col("h")), lambda x: F.conv(x, 16, 10).cast("int"))
    return codes(spark, sf_dir).select("id", F.array_join(features.downsample(every, 20), " ").alias("few"), F.array_join(pixels, " ").alias("image"))


@query(
    "preserved_sequences",
    f"""WITH {_CODE}, c AS (SELECT id, h, CASE WHEN id % 3 = 0 THEN upper(h) WHEN id % 3 = 1 THEN h || '00' ELSE h END AS e FROM code)
    SELECT count(*) AS rows, count(*) FILTER (WHERE h = lower(e)) AS preserved FROM c""",
)
def preserved_sequences(spark, sf_dir):
    """How many programs keep their bytes when a third is spelt in capitals and a third gets a byte more."""
    from quern.operators import audit

    c = codes(spark, sf_dir)
    edited = c.withColumn("h", F.when(F.col("id") % 3 == 0, F.upper("h")).when(F.col("id") % 3 == 1, F.concat("h", F.lit("00"))).otherwise(F.col("h")))
    return audit.preserved(*[x.select("id", bytecode.hex_tokens(F.col("h")).alias("ops")) for x in (c, edited)], "id", "ops")
