"""SQL fragments for oracle statements (DuckDB dialect), mirroring the
Column helpers so both engines compute the same values."""

from __future__ import annotations


def q6(expr: str) -> str:
    """Quantize to 1e-6 like ``functions.mathx.quantize``."""
    return f"(floor(CAST({expr} AS DOUBLE) * 1e6 + 0.5) / 1e6)"


def pct(expr: str) -> str:
    """Percent with two decimals like ``functions.mathx.as_percent``."""
    return f"(floor(CAST({expr} AS DOUBLE) * 1e4 + 0.5) / 100.0)"


def key_hash(key: str, salt: str) -> str:
    """Like ``operators.splits.key_hash``."""
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '{salt}'), 1, 8)) AS BIGINT)"


def split_case(key: str = "doc_id", salt: str = "split") -> str:
    """Like ``operators.splits.label_split`` with the default 70/15/15 fractions."""
    b = f"({key_hash(key, salt)} % 10000)"
    return f"(CASE WHEN {b} < 7000 THEN 'train' WHEN {b} < 8500 THEN 'validate' ELSE 'test' END)"


def safe_div(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"


def erfc(x: str) -> str:
    """A&S 7.1.26 polynomial, as ``functions.mathx.erfc``."""
    t = f"(1.0 / (1.0 + 0.3275911 * ({x})))"
    poly = (f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * "
            f"(-1.453152027 + {t} * 1.061405429)))))")
    return f"({poly} * exp(-(({x}) * ({x}))))"
