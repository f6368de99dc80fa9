import csv
import glob

from certloom.operators import present


def test_display_and_detail(certs):
    df = certs.frame(
        {"domains": ["x" * 60 + ".com", "b.com", "c.com"], "issuer_org": None, "issuer_cn": "y" * 31, "seen_at": 59},
        {"domains": ["a.com"], "issuer_org": None, "issuer_cn": None, "subject_cn": None, "log_name": ""},
    )
    long, short = present.display_row(df).orderBy("more", ascending=False).collect()
    assert (long["domain"], long["more"], long["issuer"]) == ("x" * 50 + "...", "+2", "y" * 30 + "...")
    assert long["seen_at"] == "1970-01-01 00:00"
    assert (short["domain"], short["more"], short["issuer"]) == ("a.com", "", "-")
    detail = present.detail_row(df).orderBy("domain_count").collect()
    assert (detail[0]["title"], detail[0]["log_name"]) == ("a.com", None)
    assert detail[1]["seen_at"] == "1970-01-01 00:00:59 UTC"
    assert present.feed_row(df).filter("more = '+2'").first()["domain"] == "x" * 60 + "..."


def test_csv_quoting(certs, tmp_path):
    rows = certs.frame(
        {"issuer_org": 'Quote "Q", Inc', "domains": ["a.com", "b.com"], "log_name": None, "subject_cn": " padded "},
        {"issuer_org": "Line\nbreak", "seen_at": 1},
    )
    out = str(tmp_path / "csv")
    present.export_csv(rows, out)
    text = "".join(open(f, newline="").read() for f in sorted(glob.glob(out + "/*.csv")))
    read = [r for r in csv.reader(text.splitlines(keepends=True)) if r[0] != "Fingerprint"]
    by_issuer = {r[3]: r for r in read}
    quoted = by_issuer['Quote "Q", Inc']
    assert quoted[1] == "a.com; b.com" and quoted[5] == " padded " and quoted[9] == ""
    assert quoted[6] == "2022-01-01T00:00:00.000Z"
    assert '"Quote ""Q"", Inc"' in text and "Line\nbreak" in by_issuer
    assert ',"",' not in text
