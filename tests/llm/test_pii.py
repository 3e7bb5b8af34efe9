import re

from pressmill.llm import pii

FORMS = [(f, "given") for f in ("Rumali", "Penulani", "Relani", "Wihelani", "Payalani", "Rovika", "Bevika", "Kuvika", "Pumavika", "Morareth", "Sireth", "Hahareth", "Wakareth", "Resith", "Dodosith", "Musith", "Bosith", "රුමාලි", "ருமாலி")]
FORMS += [(f, "surname") for f in ("Lumupala", "Doyapala", "Bogupala", "Nosulapala", "Lawalapala", "Rowamanayaka", "Yaganayaka", "Tenanayaka", "Pomanayaka", "ලුමුපාල", "දොයපාල", "බොගුපාල", "නොසුලපාල", "லுமுபால")]
PLACES = ["Miluela", "Hayewaawila", "මිලුඇල", "மிலுஎல", "Goyorata"]
NAMES = pii.Names(FORMS, PLACES)


def found(text):
    return [(k, text[a:b]) for a, b, k in pii.mentions(text, NAMES)]


def swapped(make, text):
    return pii.spliced(text, pii.replacements(text, NAMES, make, {}), True)


def kinds(text):
    return [k for k, _ in found(text)]


def test_numbers():
    for phone in ("0731234567", "073 123 4567", "073-1234567", "(073) 123 4567", "+94731234567", "+94 73 123 4567", "0094 73 1234567", "073/12 34 567", "073.123.4567", "O7312345O7", "０７３１２３４５６７", "zero seven three one two three four five six seven"):
        assert kinds(f"Call {phone} now") == ["phone"], phone
    for nid in ("022334455V", "022334455 v", "02 233 4455 X", "202227377654", "2025-259-84369"):
        assert kinds(f"held ({nid}).") == ["national_id"], nid
    for none in ("AD/6543/91", "TR20-319136", "Rs. 1,450,000", "in 2009 and 2010", "after 9 pm", "P/5917/67"):
        assert kinds(f"Ref {none} is none") == [], none
    assert kinds("0731234567 / 0739876543 or 0731111111") == ["phone"] * 3


def test_mail_and_addresses():
    for mail in ("a.b@inbox.test", "a.b(at)inbox.test", "a.b [at] inbox [dot] test", "a.b @ inbox.test", "a.b at inbox dot test", "A.B+ADS@INBOX.TEST"):
        assert kinds(f"Mail {mail} today") == ["email"], mail
    for place in ("No 316B Station Road", "#9/8, Second Cross Street, MILUELA", "Flat 9A, 333 Mill Road, Miluela", "178 Jak Tree Lane", "අංක 308/4, වැව පාර, මිලුඇල", "இல. 192B, கோவில் வீதி, மிலுஎல"):
        assert kinds(f"see {place}.") == ["street_address"], place
    for none in ("off Mill Road junction", "facing Temple Road", "near Miluela town", "5 rooms in Miluela"):
        assert kinds(none) == [], none


def test_names():
    assert found("Contact Rumali Lumupala on 0731234567.") == [("person_name", "Rumali Lumupala"), ("phone", "0731234567")]
    assert found("Ask W. D. Lumupala") == [("person_name", "W. D. Lumupala")]
    assert found("Speak with BOKULANI NEWONAYAKA (x)")[0][0] == "person_name"
    assert found("Rumali ta kathakaranna, Lumupala too") == [("person_name", "Rumali"), ("person_name", "Lumupala")]
    assert kinds("රුමාලි ලුමුපාල මහතා") == ["person_name"] and kinds("ருமாலி லுமுபால") == ["person_name"]
    for none in ("Listed by Lumupala & Sons.", "Lumupala Motors stock list", "Lumupala Road", "House in Miluela", "The harvest is over"):
        assert kinds(none) == [], none


def test_surrogates():
    s = pii.Surrogates(b"key", FORMS, PLACES, NAMES)
    text = "Relani Lumupala 0731234567, +94 73 123 4567 and RELANI LUMUPALA, 202227377654, No 5 Mill Road, Miluela, a@b.test"
    spans = pii.mentions(text, NAMES)
    out = swapped(s, text)
    again = pii.mentions(out, NAMES)
    assert [k for *_, k in again] == [k for *_, k in spans]
    assert not any(text[a:b] in out for a, b, _ in spans)
    numbers = [re.sub(r"\D", "", out[a:b]) for a, b, k in again if k == "phone"]
    assert numbers[0][1:] == numbers[1][2:] and numbers[0][:3] == "073"
    people = [out[a:b] for a, b, k in again if k == "person_name"]
    assert people[0].upper() == people[1] and people[0].split()[0].endswith("lani")
    assert swapped(s, text) == out != swapped(pii.Surrogates(b"other", FORMS, PLACES, NAMES), text)
    said = "x 0731234567, 0737654321 y +94 73 123 4567"
    assert pii.spliced(said, pii.replacements(said, NAMES, s, {}), False) == "x [PHONE_1], [PHONE_2] y [PHONE_1]"


def test_identity_numbers_stay_valid():
    """The gender (500 added to the day), the layout and a valid day stay, the number changes, none meet."""
    s = pii.Surrogates(b"key", FORMS, PLACES, NAMES)
    for raw in ("855012345V", "850012345X", "026146226 v", "2020-145-12559", "202371918805", "199986600001", "205012312345"):
        new = swapped(s, raw)
        assert [c.isdigit() for c in new] == [c.isdigit() for c in raw] and new != raw and not set(new) - set(raw) - set("0123456789")
        old_day, day = (int(pii._digits(x)[2:5] if len(pii._digits(x)) == 9 else pii._digits(x)[4:7]) for x in (raw, new))
        if 1 <= old_day % 500 <= 366:
            assert (day > 500) == (old_day > 500) and 1 <= day % 500 <= 366, (raw, new)
        else:
            assert not 1 <= day % 500 <= 366
    assert swapped(s, "202371918805")[:2] == "20"
    for head, numbers in ((2, [f"85{day:03d}{n:02d}" for day in range(1000) for n in range(0, 100, 7)]),):
        made = [pii.permute_identity(x, head, b"k") for x in numbers]
        assert len(set(made)) == len(numbers) and not any(a == b for a, b in zip(made, numbers))


def test_numbers_always_move():
    for n in (1, 2, 3, 4):
        assert all(pii.permute_digits(f"{i:0{n}d}", b"k", "t") != f"{i:0{n}d}" for i in range(10**n))


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 4):
        assert len({pii.permute_digits(f"{i:0{n}d}", b"k", "t") for i in range(10**n)}) == 10**n


def test_frames(spark):
    lexicon = spark.createDataFrame([("Rumali", "රුමාලි", "ருமாலி", "given"), ("Lumupala", "ලුමුපාල", None, "surname")], "name_en string, name_si string, name_ta string, name_type string")
    places = spark.createDataFrame([("l", "Miluela", None, None, "D")], "location_id string, name_en string, name_si string, name_ta string, district string")
    long = "word " * 40_000 + "0731234567"
    schema = "cand_id string, description string, phones array<string>, fld int"
    texts = spark.createDataFrame([("a", "Rumali 0731234567 0737654321", ["0737654321 / 0739999999", None, "", "0731234567"], 1), ("b", None, None, 1), ("c", "", [], 1), ("d", long, None, 1)], schema)
    got = {tuple(r) for r in pii.mention_records(texts, lexicon, places, "k").select("cand_id", "fld", "pii_type", "mention_no", "entity_no").collect()}
    described = {("a", "description", "person_name", 1, 1), ("a", "description", "phone", 1, 1), ("a", "description", "phone", 2, 2), ("d", "description", "phone", 1, 1)}
    assert got == described | {("a", "phones", "phone", 1, 2), ("a", "phones", "phone", 2, 3), ("a", "phones", "phone", 3, 1)}
    assert pii.mention_records(texts.limit(0), lexicon.limit(0), places.limit(0), "k").count() == 0
    records = spark.createDataFrame([("a", "Call 0731234567", ["0731234567", None]), ("b", None, None)], "cand_id string, description string, phones array<string>")
    rows = {r.cand_id: r for r in pii.redact(records, lexicon, places, "k").collect()}
    assert rows["a"].placeholder_text == "Call [PHONE_1]" and rows["a"].surrogate_text[5:] == rows["a"].surrogate_phones[0] and rows["a"].placeholder_phones[1] is None
    assert rows["b"].surrogate_text is None and rows["b"].surrogate_phones is None
