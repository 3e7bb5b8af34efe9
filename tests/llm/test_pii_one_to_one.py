import random

from pressmill.llm import pii
from test_pii import FORMS, NAMES, PLACES


def one_to_one(kind, raws):
    """No two different details of a kind meet, none stays, and the rest of the record does not matter."""
    s = pii.Surrogates(b"key", FORMS, PLACES, NAMES)
    seen = {}
    for raw in raws:
        new = s.shape(kind, raw, s.draw(kind, s.identity(kind, raw)))
        assert new != raw
        assert seen.setdefault(new.lower(), s.identity(kind, raw)) == s.identity(kind, raw), (raw, new)
    assert len(seen) == len({s.identity(kind, r) for r in raws})
    return seen


def test_names():
    rnd = random.Random(3)
    made = {"".join(rnd.choice("bdghklmnprstw") + rnd.choice("aeiou") for _ in range(rnd.choice((1, 2, 3)))).title() + "lani" for _ in range(2000)}
    raws = [*made, *[f for f, _ in FORMS], "Zed", "Bob", "Anura Silva", "W. D. Lumupala", "D. W. Lumupala", "W. W. Lumupala"]
    seen = one_to_one("person_name", raws)
    assert sum(n.endswith("lani") for n in seen) >= len(made)


def test_addresses():
    raws = [f"No {n}{x} {street} {kind}, {town}" for n in (1, 5, 12, 120, 398) for x in ("", "B", "/8") for street in ("Mill", "Temple", "Second Cross") for kind in ("Road", "Lane") for town in ("Miluela", "Goyorata", "Elsewhere")]
    raws += ["අංක 308/4, වැව පාර, මිලුඇල", "අංක 308/4, කඩ පාර, මිලුඇල", "இல. 192B, கோவில் வீதி, மிலுஎல", "178 Jak Tree Lane", "Flat 9A, 333 Mill Road, Miluela"]
    for new in one_to_one("street_address", raws):
        assert "mill" not in new and "temple" not in new and "cross" not in new
        assert new.split()[0] in ("no", "flat", "අංක", "இல.") or new.endswith("lane")


def test_mail():
    one_to_one("email", [f"{a}.{b}@{c}.test" for a in ("ann", "bob", "x1") for b in ("perera", "p", "22") for c in ("inbox", "mail")])
