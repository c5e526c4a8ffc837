"""The EVM instruction set as a dimension table."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Opcode, name, values taken from the stack and put on it, gas.
_ROWS = (
    (0x00, "STOP", 0, 0, 0),
    (0x01, "ADD", 2, 1, 3),
    (0x02, "MUL", 2, 1, 5),
    (0x03, "SUB", 2, 1, 3),
    (0x04, "DIV", 2, 1, 5),
    (0x05, "SDIV", 2, 1, 5),
    (0x06, "MOD", 2, 1, 5),
    (0x07, "SMOD", 2, 1, 5),
    (0x08, "ADDMOD", 3, 1, 8),
    (0x09, "MULMOD", 3, 1, 8),
    (0x0A, "EXP", 2, 1, 10),
    (0x0B, "SIGNEXTEND", 2, 1, 5),
    (0x10, "LT", 2, 1, 3),
    (0x11, "GT", 2, 1, 3),
    (0x12, "SLT", 2, 1, 3),
    (0x13, "SGT", 2, 1, 3),
    (0x14, "EQ", 2, 1, 3),
    (0x15, "ISZERO", 1, 1, 3),
    (0x16, "AND", 2, 1, 3),
    (0x17, "OR", 2, 1, 3),
    (0x18, "XOR", 2, 1, 3),
    (0x19, "NOT", 1, 1, 3),
    (0x1A, "BYTE", 2, 1, 3),
    (0x1B, "SHL", 2, 1, 3),
    (0x1C, "SHR", 2, 1, 3),
    (0x1D, "SAR", 2, 1, 3),
    (0x20, "KECCAK256", 2, 1, 30),
    (0x30, "ADDRESS", 0, 1, 2),
    (0x31, "BALANCE", 1, 1, 100),
    (0x32, "ORIGIN", 0, 1, 2),
    (0x33, "CALLER", 0, 1, 2),
    (0x34, "CALLVALUE", 0, 1, 2),
    (0x35, "CALLDATALOAD", 1, 1, 3),
    (0x36, "CALLDATASIZE", 0, 1, 2),
    (0x37, "CALLDATACOPY", 3, 0, 3),
    (0x38, "CODESIZE", 0, 1, 2),
    (0x39, "CODECOPY", 3, 0, 3),
    (0x3A, "GASPRICE", 0, 1, 2),
    (0x3B, "EXTCODESIZE", 1, 1, 100),
    (0x3C, "EXTCODECOPY", 4, 0, 100),
    (0x3D, "RETURNDATASIZE", 0, 1, 2),
    (0x3E, "RETURNDATACOPY", 3, 0, 3),
    (0x3F, "EXTCODEHASH", 1, 1, 100),
    (0x40, "BLOCKHASH", 1, 1, 20),
    (0x41, "COINBASE", 0, 1, 2),
    (0x42, "TIMESTAMP", 0, 1, 2),
    (0x43, "NUMBER", 0, 1, 2),
    (0x44, "PREVRANDAO", 0, 1, 2),
    (0x45, "GASLIMIT", 0, 1, 2),
    (0x46, "CHAINID", 0, 1, 2),
    (0x47, "SELFBALANCE", 0, 1, 5),
    (0x48, "BASEFEE", 0, 1, 2),
    (0x49, "BLOBHASH", 1, 1, 3),
    (0x4A, "BLOBBASEFEE", 0, 1, 2),
    (0x50, "POP", 1, 0, 2),
    (0x51, "MLOAD", 1, 1, 3),
    (0x52, "MSTORE", 2, 0, 3),
    (0x53, "MSTORE8", 2, 0, 3),
    (0x54, "SLOAD", 1, 1, 100),
    (0x55, "SSTORE", 2, 0, 100),
    (0x56, "JUMP", 1, 0, 8),
    (0x57, "JUMPI", 2, 0, 10),
    (0x58, "PC", 0, 1, 2),
    (0x59, "MSIZE", 0, 1, 2),
    (0x5A, "GAS", 0, 1, 2),
    (0x5B, "JUMPDEST", 0, 0, 1),
    (0x5C, "TLOAD", 1, 1, 100),
    (0x5D, "TSTORE", 2, 0, 100),
    (0x5E, "MCOPY", 3, 0, 3),
    (0x5F, "PUSH0", 0, 1, 2),
    (0xF0, "CREATE", 3, 1, 32000),
    (0xF1, "CALL", 7, 1, 100),
    (0xF2, "CALLCODE", 7, 1, 100),
    (0xF3, "RETURN", 2, 0, 0),
    (0xF4, "DELEGATECALL", 6, 1, 100),
    (0xF5, "CREATE2", 4, 1, 32000),
    (0xFA, "STATICCALL", 6, 1, 100),
    (0xFD, "REVERT", 2, 0, 0),
    (0xFE, "INVALID", 0, 0, 0),
    (0xFF, "SELFDESTRUCT", 1, 0, 5000),
)
TERMINATORS = frozenset({"STOP", "RETURN", "REVERT", "INVALID", "SELFDESTRUCT", "JUMP"})
HALTS = TERMINATORS - {"JUMP"}


@lru_cache(maxsize=1)
def table() -> dict[int, tuple[str, int, int, int]]:
    """Byte -> (name, pops, pushes, gas); the numbered families follow a rule."""
    out = {b: (name, pops, pushes, gas) for b, name, pops, pushes, gas in _ROWS}
    for n in range(1, 33):
        out[0x5F + n] = (f"PUSH{n}", 0, 1, 3)
    for n in range(1, 17):
        out[0x7F + n] = (f"DUP{n}", n, n + 1, 3)
        out[0x8F + n] = (f"SWAP{n}", n + 1, n + 1, 3)
    for n in range(5):
        out[0xA0 + n] = (f"LOG{n}", n + 2, 0, 375 * (n + 1))
    return out


@lru_cache(maxsize=1)
def vocabulary() -> tuple[str, ...]:
    """Token of each byte in order, PUSH1..32 being one; bytes without an instruction are UNK_xx."""
    known = table()
    names = []
    for b in range(256):
        name = "PUSH" if 0x60 <= b <= 0x7F else known[b][0] if b in known else f"UNK_{b:02x}"
        if name not in names:
            names.append(name)
    return tuple(names)


def category(code: int) -> str:
    """What an instruction works on, by its range."""
    if code == 0x20:
        return "hash"
    if code in (0x54, 0x55, 0x5C, 0x5D):
        return "storage"
    if code in (0x56, 0x57, 0x58, 0x5B, 0x00, 0xF3, 0xFD, 0xFE, 0xFF):
        return "control"
    kinds = ("arithmetic", "logic", "hash", "environment", "block", "memory", "push", "push", "stack", "stack", "log")
    return kinds[code >> 4] if code >> 4 < len(kinds) else "call"


def dimension(spark: SparkSession) -> DataFrame:
    """(code, name, pops, pushes, gas, category), one row per instruction: at most 256."""
    rows = [(b, *v, category(b)) for b, v in sorted(table().items())]
    return spark.createDataFrame(rows, "code int, name string, pops int, pushes int, gas int, category string")
