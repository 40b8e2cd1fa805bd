"""DuckDB twins of the queries, with the parameters written in. They follow the definitions, not the engine."""

from __future__ import annotations

from quantaloom.functions.exprs import crc32c_table
from quantaloom.functions.params import QuantParams


def numbers(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]"


def whole(values) -> str:
    return "[" + ", ".join(str(int(v)) for v in values) + "]"


class Twins:
    """Common table expressions for one parameter set; each name builds on those before it."""

    def __init__(self, p: QuantParams) -> None:
        self.p, d, b = p, p.dim, p.mse_bits
        level = " + ".join(f"CAST(v > {float(m)!r} AS INTEGER)" for m in p.midpoints)
        words = -(-d * b // 32)
        self.parts = {
            "perm": f"SELECT unnest(range({d})) AS coord, unnest({whole(p.perm)}) AS src, unnest({numbers(p.signs)}) AS sign",
            "cent": f"SELECT unnest(range({1 << b})) AS k, unnest({numbers(p.centroids)}) AS c",
            "rot": "SELECT vec_id, label, coord, src, sign, sign * CAST(embedding[src + 1] AS DOUBLE) AS v FROM embeddings, perm",
            "q": f"SELECT vec_id, label, coord, src, sign, v, {level} AS idx FROM rot",
            "deq": "SELECT vec_id, label, coord, src, sign, v, idx, c, v - c AS res FROM q JOIN cent ON k = idx",
            "norm": "SELECT vec_id, sqrt(sum(res * res)) AS residual_norm FROM deq GROUP BY vec_id",
            "proj": f"SELECT i // {d} AS row, i % {d} AS r, v AS p FROM (SELECT unnest(range({d * d})) AS i, unnest({numbers(p.rotated_projection.ravel())}) AS v)",
            "dots": "SELECT vec_id, row, sum(p * res) AS dot FROM deq JOIN proj ON r = coord GROUP BY vec_id, row",
            "sgn": "SELECT vec_id, row, CASE WHEN dot >= 0 THEN 1 ELSE -1 END AS sign FROM dots",
            "bits": f"SELECT vec_id, coord * {b} + j AS pos, (idx >> j) & 1 AS bit FROM q, (SELECT unnest(range({b})) AS j)",
            "words": "SELECT vec_id, pos // 32 AS w, CAST(sum(CAST(bit AS BIGINT) << (pos % 32)) AS BIGINT) AS word FROM bits GROUP BY vec_id, pos // 32",
            "xored": "SELECT vec_id, w, xor(word, lag(word, 1, 0) OVER (PARTITION BY vec_id ORDER BY w)) AS word FROM words",
            "bytes": f"SELECT vec_id, list((word >> (8 * j)) & 255 ORDER BY w, j) AS b FROM (SELECT * FROM words UNION ALL SELECT DISTINCT vec_id, {words}, {d * b} FROM words), (SELECT unnest(range(4)) AS j) GROUP BY vec_id",
            "hist": f"SELECT s.vec_id, s.symbol, count(q.idx) AS n FROM (SELECT DISTINCT vec_id, unnest(range({1 << b})) AS symbol FROM embeddings) s LEFT JOIN q ON q.vec_id = s.vec_id AND q.idx = s.symbol GROUP BY s.vec_id, s.symbol",
        }
        self.needs = {
            "rot": ["perm"], "q": ["rot"], "deq": ["q", "cent"], "norm": ["deq"], "dots": ["deq", "proj"], "sgn": ["dots"], "bits": ["q"], "words": ["bits"],
            "xored": ["words"], "bytes": ["words"], "hist": ["q"], "tree": ["hist"], "code": ["tree"],
        }
        # Huffman trees, all vectors at once: the open nodes as a sorted list of (weight, node), the two least joined each step.
        n = 1 << b
        self.parts["tree"] = f"""SELECT * FROM (WITH RECURSIVE step(vec_id, i, open, links) AS (
  SELECT vec_id, {n}, list_sort(list({{'w': n + 1, 'node': symbol}})), CAST([] AS STRUCT(child BIGINT, up BIGINT, bit BIGINT)[]) FROM hist GROUP BY vec_id
  UNION ALL
  SELECT vec_id, i + 1, list_sort(list_append(open[3:], {{'w': open[1].w + open[2].w, 'node': i}})),
         links || [{{'child': open[1].node, 'up': i, 'bit': 0}}, {{'child': open[2].node, 'up': i, 'bit': 1}}]
  FROM step WHERE len(open) > 1)
SELECT vec_id, unnest(links, recursive := true) FROM step WHERE len(open) = 1)"""
        self.parts["code"] = f"""SELECT * FROM (WITH RECURSIVE walk(vec_id, symbol, node, code) AS (
  SELECT vec_id, child, up, CAST(bit AS VARCHAR) FROM tree WHERE child < {n}
  UNION ALL
  SELECT walk.vec_id, symbol, up, CAST(bit AS VARCHAR) || code FROM walk JOIN tree ON tree.vec_id = walk.vec_id AND tree.child = walk.node)
SELECT vec_id, symbol, arg_max(code, length(code)) AS code FROM walk GROUP BY vec_id, symbol)"""

    def sql(self, select: str, *uses: str) -> str:
        order: list[str] = []

        def add(name: str) -> None:
            for below in self.needs.get(name, []):
                add(below)
            if name not in order:
                order.append(name)

        for name in uses:
            add(name)
        return ("WITH " + ",\n".join(f"{name} AS MATERIALIZED ({self.parts[name]})" for name in order) + "\n" if order else "") + select


def crc32c_of(list_column: str) -> str:
    """CRC-32C of a list of byte values."""
    table = whole(crc32c_table())
    return f"xor(list_reduce({list_column}, lambda crc, b: xor({table}[(xor(crc, b) & 255) + 1], crc >> 8), CAST(4294967295 AS BIGINT)), 4294967295)"
