"""SQL for SimHash groups: XXH64 in unsigned 128-bit arithmetic, stage by stage.

Every stage is a materialised table with one more column, so that no term is
written out twice; a stripe, a word or a byte of the input is folded in by a
lambda over a list.
"""

from __future__ import annotations

# The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_FULL = 1 << 64


def _big(n: int) -> str:
    return f"{n % _FULL}::UHUGEINT"


def _mod(x: str) -> str:
    return f"(({x}) & {_big(-1)})"


def _times(x: str, p: int) -> str:
    return _mod(f"({x}) * {_big(p)}")


def _rotated(x: str, by: int) -> str:
    return f"({_mod(f'({x}) << {by}')} + (({x}) >> {64 - by}))"


def _fold(first: str, rest: str, step: str) -> str:
    """``step`` over h, which starts as ``first``, and x, each of ``rest``."""
    return f"list_reduce(list_prepend({first}, {rest}), lambda h, x: {step})"


def _number(at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes of the hex text hx from the digit before ``at`` on."""
    return "('0x' || " + " || ".join(f"substr(hx, {at} + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def _round(x: str) -> str:
    return _times(_rotated(_times(x, P2), 31), P1)


def hash_stages(seed: int) -> list[tuple[str, str, str]]:
    """(name, source, column): from shingles (g, hx, n) to hashed, with the hash x64."""

    def lane(k: int, first: int) -> str:
        words = f"list_transform(range(0, n // 32), lambda s: w[4 * s + {k}])"
        return _fold(_big(first), words, _times(_rotated(_mod(f"h + {_times('x', P2)}"), 31), P1)) + f" AS v{k}"

    def merged(h: str, v: str) -> str:
        return _mod(f"{_times(f'xor({h}, {_round(v)})', P1)} + {_big(P4)}")

    bytes_left = "list_transform(range(n - n % 4, n), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::UBIGINT::UHUGEINT)"
    four = _times(_number("16 * (n // 8)", 4), P1)
    return [
        ("s0", "shingles", f"list_transform(range(0, n // 8), lambda k: {_number('16 * k', 8)}) AS w"),
        ("s1", "s0", ", ".join(lane(k, v) for k, v in enumerate((seed + P1 + P2, seed + P2, seed, seed - P1), 1))),
        ("s2", "s1", _mod(" + ".join(_rotated(f"v{k}", by) for k, by in ((1, 1), (2, 7), (3, 12), (4, 18)))) + " AS a0"),
        *[(f"s{2 + k}", f"s{1 + k}", merged(f"a{k - 1}", f"v{k}") + f" AS a{k}") for k in range(1, 5)],
        ("s7", "s6", _mod(f"CASE WHEN n >= 32 THEN a4 ELSE {_big(seed + P5)} END + n::UHUGEINT") + " AS b0"),
        ("s8", "s7", _fold("b0", "w[4 * (n // 32) + 1:]", _mod(f"{_times(_rotated(f'xor(h, {_round("x")})', 27), P1)} + {_big(P4)}")) + " AS b1"),
        ("s9", "s8", f"CASE WHEN n % 8 >= 4 THEN {_mod(_times(_rotated(f'xor(b1, {four})', 23), P2) + ' + ' + _big(P3))} ELSE b1 END AS b2"),
        ("s10", "s9", _fold("b2", bytes_left, _times(_rotated(f"xor(h, {_times('x', P5)})", 11), P1)) + " AS b3"),
        ("s11", "s10", _times("xor(b3, b3 >> 33)", P2) + " AS b4"),
        ("s12", "s11", _times("xor(b4, b4 >> 29)", P3) + " AS b5"),
        ("hashed", "s12", "xor(b5, b5 >> 32)::UBIGINT AS x64"),
    ]


def near_groups_sql(seed: int = 42, distance: int = 3) -> str:
    """doc_id, fingerprint and component_id of ``documents``, over three-word shingles."""
    stages = ", ".join(f"{name} AS MATERIALIZED (SELECT *, {column} FROM {source})" for name, source, column in hash_stages(seed))
    bits = " + ".join(f"CASE WHEN 2 * sum((x64 >> {b}) & 1) > count(*) THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))
    return rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), grams AS (
            SELECT doc_id, array_to_string(words[s:s + 2], ' ') AS g
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS s FROM d WHERE len(words) > 0)
        ), shingles AS (
            SELECT g, hex(encode(g)) AS hx, strlen(g) AS n FROM (SELECT DISTINCT g FROM grams)
        ), {stages}, prints AS (
            SELECT doc_id, {bits} AS fp FROM grams JOIN (SELECT g, x64 FROM hashed) USING (g) GROUP BY doc_id
        ), named AS (
            SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN prints USING (doc_id)
        ), classes AS (
            SELECT fp, min(doc_id) AS least FROM named GROUP BY fp
        ), links AS (
            SELECT a.fp AS u, b.fp AS v FROM classes a JOIN classes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::HUGEINT) <= {distance}
        ), reach AS (
            SELECT fp, fp AS far FROM classes UNION SELECT reach.fp, v FROM reach JOIN links ON far = u
        ), roots AS (
            SELECT reach.fp, min(least) AS component_id FROM reach JOIN classes ON far = classes.fp GROUP BY reach.fp
        )
        SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM named JOIN roots USING (fp)
    """
