import hashlib
import random
import re

import numpy as np

from ridgeline.llm.pii import KINDS, base_spans, candidates, features, find_pii, luhn, train, training_examples

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
digits = lambda s: re.sub(r"[^0-9]", "", s)


def brute(t):
    t = t or ""
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return out


def texts():
    rnd = random.Random(11)
    parts = list("@@..  --+0123456789()abZ%_") + ["é", "𝄞", "\n", "4111111111111111", "4111 1111-1111 1111", "10.0.0.255", "256.1.1.1", "x@y.z", "+1 (555) 123-4567", " at ", " dot com", "01.02.003.4", "٣"]
    out = [None, "", "a@b@c.d.e@f.g", "1.2.3.4.5.6.7.8.9", "@a.b", "a@b", "é" * 5 + "x@y.z", "1" * 50_000, "a" * 50_000 + "@", "1." * 30_000, "+1" * 9000]
    return out + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 40))) for _ in range(1500)]


def test_base_against_brute_force():
    for t in texts():
        if t is None or len(t) < 5000:
            assert base_spans(t or "") == brute(t), t
        else:
            base_spans(t)


def test_query_rows(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, n_ip int").repartition(4)
    got = {r.doc_id: r for r in find_pii(df, train()).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = base_spans(t or "")
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in base) for k in range(4)]
        assert set(text.split(",")) <= set(r.spans.split(",")) | {""}
    assert find_pii(df.limit(0), train()).count() == 0


def test_selector_is_precise():
    x, y = training_examples(2500, seed=77)
    model = train()
    p = model.calibration.apply(model.booster.margin(x))
    take = p >= model.thresholds[x[:, 0].astype(int)]
    assert y[take].mean() > 0.93 and take[y == 1].mean() > 0.6


def test_adds_spans():
    model = train()
    from ridgeline.llm.pii import all_spans

    text = "please write to jane.doe [at] mailhost [dot] org or call (415) 555-2671 today"
    found = {(KINDS[k], text[a:b]) for k, a, b in all_spans(text, model)[1]}
    assert ("email", "jane.doe [at] mailhost [dot] org") in found and ("phone", "(415) 555-2671") in found
    plain = "chapter 12 has 1200 pages in 2024-01-12 and table 44 of section 7.2.1"
    assert all_spans(plain, model)[1] == []
    assert len(features(text, next(iter(candidates(text))))) == np.shape(training_examples(10)[0])[1]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.redacted for r in find_pii(df, train()).collect()}
    assert got == {1: "mail [email] now", 2: ""}


def test_numbers_beside_numbers():
    from ridgeline.llm.pii import all_spans

    for text in ("call 555-123-4567 555-987-6543", "tel 555-123-4567. 3 items", "card 4111.1111.1111.1111 12/27 123"):
        proposed = {text[c.start : c.stop] for c in candidates(text)}
        groups = [m.span() for m in re.finditer("[0-9]+", text)]
        every = {text[a:b] for i, (a, _) in enumerate(groups) for _, b in groups[i:] if 7 <= len(digits(text[a:b])) <= 19}
        assert proposed == every
    model = train()
    for text, want in (
        ("call 555-123-4567 555-987-6543", [("phone", "555-123-4567"), ("phone", "555-987-6543")]),
        ("tel 555-123-4567. 3 items", [("phone", "555-123-4567")]),
        ("card 4111.1111.1111.1111 12/27 123", [("card", "4111.1111.1111.1111")]),
        ("auxai 7536784127813050 4845168114407329 oile", [("card", "7536784127813050"), ("card", "4845168114407329")]),
        ("Des +1 (826) 555-4081 190.137.223.204 du", [("ip", "190.137.223.204"), ("phone", "+1 (826) 555-4081")]),
    ):
        assert [(KINDS[k], text[a:b]) for k, a, b in all_spans(text, model)[1]] == want


#: Written by hand, apart from the templates that the trees learn from; marked
#: as [kind:span] is what a reader takes for personal data beyond the base
#: formats. Misses among the first 36 made us widen the templates (spaces in
#: European numbers, brackets around "at") and all of them chose the trees' size,
#: so what this holds to is precision, and recall of such formats.
HAND = """
Ring the office on [phone:020 7946 0018] before five, or leave a note with Priya.
Her new mobile is [phone:07700 900123], the old one no longer works.
For bookings telephone [phone:(0131) 496 0555] between nine and noon.
My number: [phone:212-555-0187]. Text me when you land!
Kontakt: Telefon [phone:030 901820], Fax [phone:030/901821].
Appelez le [phone:01 42 68 53 00] pour un rendez-vous.
Llámame al teléfono [phone:612 345 678] mañana por la tarde.
Please call [phone:555.867.5309] and ask for Jenny.
Write to [email:sam.hill at brightmail dot com] with your questions.
Reach the editor under [email:editor [at] weeklypost [dot] org] any time.
Send the invoice to [email:accounts(at)northwind(dot)net] please.
The maintainer is [email:k_ito [at] riverlab.de], patches welcome.
Login attempts from [ip:192[.]168[.]4[.]77] were blocked at midnight.
The bad host was [ip:10(.)0(.)12(.)9] according to the log.
Paid by card [card:4242.4242.4242.4242], exp 04/29.
Charge my Visa [card:4012/8888/8888/1881] and send the receipt.
The account was paid with mastercard [card:5555.5555.5555.4444] last week.
Meet me at the station at noon. Bring the map at least.
The committee met at Geneva in 1987 and again at Lisbon in 1994.
Revenue rose from 1.204.300 to 1.377.950 in the quarter.
Between 2019-03-01 and 2021-11-30 we logged 14 502 incidents.
See ISBN 978-0-306-40615-7 in the reading list of chapter 4.
The order 20230417001823 shipped on 17.04.2023.
Version 10.4.2201.118 fixes the crash reported in build 90125567.
The series runs 3 5 8 13 21 34 55 89 144 233 377 610.
Coordinates 48.858370 2.294481 mark the tower.
Temperatures of 12.5 13.0 14.25 and 15.75 were measured at four sites.
Pages 1204-1219 discuss the 1848-1851 uprisings in detail.
Serial 00012345678901 was recalled along with lot 445566778.
He lived at 221 Baker Street and paid 1,200 in rent.
The match ended 25-23 21-25 25-18 19-25 15-12 after two hours.
Item 4006381333931 has the barcode printed on the back.
Sum 100 200 300 400 500 600 equals 2100 as expected.
It takes 86400 seconds, or 1440 minutes, to see it once around.
At 10:15:30 the probe was 384400 km away and at 11:15:30 a little farther.
Population 8 336 817 in 2019 against 8 804 190 in 2020.
Dial [phone:0800 1111] free of charge, day or night.
Reach reception by phone under [phone:0221 4710815] until six.
Texting [phone:(503) 555-0147] is fine, calling is better.
Fax the form to [phone:04 72 10 30 30] and keep a copy.
The plumber, mobile [phone:07911 123456], comes on Tuesdays.
Mail [email:ana.ruiz at correo dot es] or drop by the desk.
Questions go to [email:help[at]openatlas[dot]io] as usual.
For press, contact [email:press_team (at) harborfm (dot) com] directly.
Traffic came from host [ip:172[.]16[.]254[.]1] all night.
She gave the credit card [card:6011.1111.1111.1117] over the counter.
Debit card [card:3782/8224/6310/0053] was declined, then [card:4000.0566.5566.5556] worked.
Look at the ridge. Com towers stand on it at dawn.
We saw 12 000 birds on 3 May, 15 500 on 4 May and 9 200 on 5 May.
The equation has 3 roots: 0.125 0.375 and 0.875 exactly.
Invoice 2024-000178-33 was settled on 02.02.2024.
Her score of 9 876 543 points beat the record of 9 123 456.
Lines 100-250 and 300-450 of file 7 are generated.
The tower is 324 m tall, built 1887-1889, visited by 6 200 000 people.
In 1990 1995 2000 and 2005 the census counted 52 58 61 and 63 million.
Bus 42 leaves at 07:15 07:45 08:15 and 08:45 from stop 1180.
"""


def test_added_spans_on_hand_marked_texts():
    from ridgeline.llm.pii import all_spans

    model = train()
    right, wrong, missed = 0, [], []
    for line in HAND.strip().split("\n"):
        text, want, at = "", set(), 0
        for m in re.finditer(r"\[(email|ip|card|phone):((?:[^\[\]]|\[[^\]]*\])*)\]", line):
            text += line[at : m.start()]
            want.add((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        text += line[at:]
        base = set(base_spans(text))
        got = {(KINDS[k], a, b) for k, a, b in all_spans(text, model)[1] if (k, a, b) not in base}
        right += len(got & want)
        wrong += [text[a:b] for _, a, b in got - want]
        missed += [text[a:b] for _, a, b in want - got]
    print("right", right, "wrong", wrong, "missed", missed)
    assert not wrong and right >= 0.8 * (right + len(missed)) and right + len(missed) == 30
