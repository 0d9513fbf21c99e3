"""Turn repair against a search over all edits, and odd rows."""

import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyward.llm import turnrepair

WHITE = " \t\n\x0b\f\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        out.append("b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows):
    """(cost, audit, lines) by trying every edit of every row, with up to two insertions anywhere."""
    level = {("", ""): (0, "", ())}  # (initials, audit) -> the cheapest

    def inserted(level):
        out = dict(level)
        for _ in range(2):
            for (initials, _), (c, a, lines) in list(out.items()):
                for r in ("user", "assistant"):
                    if re.fullmatch("s?(ua)*u?", initials + r[0]):
                        out.setdefault((initials + r[0], a + "I"), (c + 5, a + "I", (*lines, r + ":")))
        return out

    for (role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for (initials, _), (c, a, lines) in inserted(level).items():
            options = [(c + 2, "D", initials, lines)]
            if fault not in ("b", "d"):
                extra = 5 if fault == "t" else 0
                options.append((c + extra, "K", initials + role[:1], (*lines, f"{role}:{text}")))
                options += [(c + extra + 1, "R", initials + r[0], (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
            for cost, letter, to, said in options:
                if (role[:1] or letter != "K") and re.fullmatch("s?(ua)*u?", to):
                    key = (to, a + letter)
                    if key not in new or cost < new[key][0]:
                        new[key] = (cost, a + letter, said)
        level = new
    done = [(c, a, lines) for (initials, _), (c, a, lines) in inserted(level).items() if re.fullmatch("(s?(ua)+)?", initials)]
    return min(done)


ROLE = st.sampled_from(["user", "assistant", "system", "tool", "", "unknown"])
TEXT = st.sampled_from(["Yes.", "no", "", " \t", "What?\n", "b.a", "Fine! ", "x\x0b"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=5))
def test_parser_equals_search(rows):
    repair = turnrepair.Repair()
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        repair.row(role, text, fault in ("b", "d") and fault != "", fault == "t")
    cost, audit, lines = search(rows)
    assert repair.end() == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    """Plain version of the damage: (conv, turn, role, text) rows, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = damage([r for r in rows if r[0] == conv])
        said = [(r[2], r[3]) for r in own]
        kinds = faults(said)
        turns = {r[1] for r in own if r[1] is not None}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:], strict=False)]
        cost, audit, lines = search(said)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repaired_equals_plain_version(spark):
    texts = ["Yes.", "no", None, "", "Really?", "Same.", "Same.", "long " * 20_000 + "."]
    rows = [(c, None if (c + t) % 11 == 0 else t * (1 + c % 2), [None, "user", "assistant", "system", "tool"][(c * 7 + t * 3) % 5], texts[(c + t * t) % len(texts)]) for c in range(60) for t in range(c % 6)]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (7, 3, "user", "Tie."), (7, 3, "assistant", "Tie."), (7, 3, "user", "Tie."), (-5, 10**18, "user", "Far."), (-5, -(10**18), "assistant", "Off.")]
    df = spark.createDataFrame([(*r, 9, "x", True) for r in rows], "conv_id long, turn long, role string, text string, times int, _digest string, blank boolean").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in turnrepair.repaired(turnrepair.damaged(df)).collect()}
    assert got == plain(rows)
    assert turnrepair.repaired(turnrepair.damaged(df.limit(0))).count() == 0


def test_long_conversation_is_streamed(spark):
    n = 30_000
    df = spark.range(n).selectExpr("1 AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "CASE WHEN id < 3 THEN '' ELSE concat('t', id, '.') END AS text").repartition(6)
    r = turnrepair.repaired(turnrepair.as_rows(df)).first()
    # three blank rows go, then an assistant row that nothing precedes and the rest in pairs
    assert (r.blank, r.cost, len(r.audit), r.audit[:5], set(r.audit[4:])) == (3, 3 * 2 + 2, n, "DDDDK", {"K"})
