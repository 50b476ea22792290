"""Newton's method for logistic regressions written out as SQL views, one pair of views per step."""

from __future__ import annotations

from collections.abc import Sequence


def newton_ctes(rows: str, x: Sequence[str], penalty: float, steps: int, by: str = "", prefix: str = "nt") -> dict[str, str]:
    """Views ending in ``{prefix}_b`` (by, b0, b1, ...) from ``rows`` (by, y, w and the columns ``x``)."""
    q = len(x) + 1
    value = ["1.0", *x]
    pairs = [(i, j) for i in range(q) for j in range(i + 1)]
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    join = f"JOIN {{b}} USING ({by})" if by else ", {b}"
    betas = ", ".join(f"b{i}" for i in range(q))
    out = {f"{prefix}_b0": f"SELECT DISTINCT {key}" + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(q)) + f" FROM {rows}"}

    lower: list[str] = []
    for i in range(q):
        for j in range(i + 1):
            rest = "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            lower.append(f"sqrt(h{i}_{i}{rest}) AS l{i}_{i}" if i == j else f"(h{i}_{j}{rest}) / l{j}_{j} AS l{i}_{j}")
    for i in range(q):
        lower.append(f"(g{i}" + "".join(f" - l{i}_{k} * z{k}" for k in range(i)) + f") / l{i}_{i} AS z{i}")
    for i in reversed(range(q)):
        lower.append(f"(z{i}" + "".join(f" - l{k}_{i} * d{k}" for k in range(i + 1, q)) + f") / l{i}_{i} AS d{i}")

    for step in range(1, steps + 1):
        before, last = f"{prefix}_b{step - 1}", step == steps
        eta = " + ".join(f"b{i} * {v}" for i, v in enumerate(value))
        gradient = [f"sum(w * (p - y) * {v}) + {penalty if i else 0.0} * any_value(b{i}) AS g{i}" for i, v in enumerate(value)]
        second = [f"sum(w * p * (1 - p) * {value[i]} * {value[j]}) + {penalty if i == j and i else 0.0} AS h{i}_{j}" for i, j in pairs]
        carried = ", ".join(f"any_value(b{i}) AS b{i}" for i in range(q))
        out[f"{prefix}_s{step}"] = f"""SELECT {key}{carried}, {', '.join(gradient)}, {', '.join(second)}
            FROM (SELECT {key}y, w, {', '.join(x)}, {betas}, 1 / (1 + exp(-({eta}))) AS p FROM {rows} {join.format(b=before)}) AS e {group}"""
        # One projection per column: an alias used beside its definition would be written out again.
        solved = f"{prefix}_s{step}"
        for n, column in enumerate(lower):
            solved = f"(SELECT *, {column} FROM {solved}) AS c{n}"
        out[f"{prefix}_b" if last else f"{prefix}_b{step}"] = f"SELECT {key}" + ", ".join(f"b{i} - d{i} AS b{i}" for i in range(q)) + f" FROM {solved}"
    return out
