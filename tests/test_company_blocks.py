"""Blocks of companies against a line-by-line walk."""

import random
import re

from rulewright.operators import company_blocks

ROLE = re.compile(company_blocks.ROLE, re.I)


def walk(lines):
    """Blocks of one image by walking down the lines; lines are texts."""
    texts = [t.strip(" |;,.") for t in lines]
    out = []
    for i, raw in enumerate(lines):
        if not texts[i] or not (m := ROLE.search(raw)):
            continue
        role = next(k for k, words in company_blocks.ROLES.items() if re.match("[A-Za-z]+", m[0])[0].lower() in words)
        ended = company_blocks.ENDED_BY.get(role)
        stop = lambda t: ended and re.search(ended, t, re.I)
        own, kept = raw.strip()[ROLE.search(raw.strip()).end() :].strip(" :–-=|"), []
        if x := stop(own):
            own = own[: x.start()].strip(" :–-=|;,.")
        if len(own) > 1 and not re.match(r"^[a-zA-Z]\s*\|?$", own):
            kept.append(own)
        for t in texts[i + 1 :]:
            if not t:
                continue
            if len(kept) >= 10 or re.search(company_blocks.DECLARATION, t, re.I):
                break
            if x := stop(t):
                before = t[: x.start()].strip(" |;,.")
                kept += [before] if len(before) > 2 else []
                break
            kept.append(t)
        at = next((k for k, t in enumerate(kept) if re.search(company_blocks.COMPANY, t, re.I) or len(t) >= 6), 0)
        out.append((i, role, kept[at] if kept else None, kept[:at] + kept[at + 1 :]))
    return out


def test_blocks_equal_a_walk(spark):
    r = random.Random(5)
    some = ["Mfd. by: Acme Foods Pvt Ltd", "MANUFACTURED & PACKED BY", "Mktd by: Zed | Mfg by Q Ltd", "marketed by", "Imported by : X", "PIN 411001", "Plot 5", "Pune, Maharashtra 411 001", "400705 Goa", "MRP Rs 5", "Net Qty 5 g", "", " | ", "abc", "ab", "Beta Industries", "at Delhi mfg by Sun LLP", None]
    images = [[r.choice(some) for _ in range(r.randint(0, 25))] for _ in range(60)]
    rows = [(k, i, t) for k, texts in enumerate(images) for i, t in enumerate(texts)]
    got = company_blocks.company_blocks(spark.createDataFrame(rows, "image_id int, line_id int, text string").repartition(4)).collect()
    want = sorted((k, i, role, company or "", address) for k, texts in enumerate(images) for i, role, company, address in walk([t or "" for t in texts]))
    assert sorted((x["image_id"], x["line_id"], x["role"], x["company"] or "", x["address"]) for x in got) == want


def test_codes_states_and_confidence(spark):
    rows = [(1, 1, "Mfg. by:"), (1, 2, "Sun"), (1, 3, "Sun Wellness"), (1, 4, "Nr. Lake, Tamil Nadu - PIN: 600001"), (1, 5, "Best before 6 months"), (2, 1, "Packed by"), (3, 1, "Imported by Q R"), (3, 2, "x")]
    got = {x["image_id"]: x for x in company_blocks.company_blocks(spark.createDataFrame(rows, "image_id int, line_id int, text string")).collect()}
    assert (got[1]["company"], got[1]["address"], got[1]["pin_code"], got[1]["state"], got[1]["confidence"]) == ("Sun Wellness", ["Sun", "Nr. Lake, Tamil Nadu - PIN: 600001"], "600001", "Tamil Nadu", 0.95)
    assert got[2]["company"] is None and got[2]["confidence"] == 0.0 and got[2]["role"] == "PACKER"
    assert got[3]["company"] == "Q R" and got[3]["confidence"] == 0.90 and got[3]["address"] == ["x"]


def test_numbers_of_plots_are_no_codes(spark):
    rows = [(1, 1, "Mfd by: A Foods Ltd"), (1, 2, "Plot 100000"), (1, 3, "Goa 500000"), (2, 1, "Mfd by: A Foods Ltd"), (2, 2, "PLOT NO. 123456, Goa - PIN: 403001"), (3, 1, "Mfd by: A Foods Ltd"), (3, 2, "Plot 700000"), (3, 3, "Goa 1100000")]
    lines = spark.createDataFrame(rows, "image_id int, line_id int, text string")
    assert {x["image_id"]: x["pin_code"] for x in company_blocks.company_blocks(lines).collect()} == {1: "500000", 2: "403001", 3: None}
    longer = company_blocks.PIN.replace("{5}", "{5,}")
    assert {x["image_id"]: x["pin_code"] for x in company_blocks.company_blocks(lines, code=longer).collect()} == {1: "500000", 2: "403001", 3: "1100000"}
