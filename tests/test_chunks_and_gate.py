"""Chunks and the candidates' gate by stated cases."""

import pytest

from sieveline.operators import filters, texts


def naive_pieces(body, most=900, overlap=140):
    """Piece by piece, with the whole rest looked at each time."""
    parts, at = [], 0
    while at < len(body):
        end = at + 1
        while end < len(body) and body[end : end + 2] != "\n\n":
            end += 1
        if body[at:end].strip():
            parts.append((at, body[at:end].strip()))
        at = end
    out, held, start = [], None, 0
    for at, p in parts:
        if held is None and len(p) > most:
            k = 0
            while k < len(p):
                out.append((at + k, p[k : k + most]))
                k += most - overlap
        elif held is None:
            held, start = p, at
        elif len(held + "\n\n" + p) <= most:
            held += "\n\n" + p
        else:
            out.append((start, held))
            held, start = (held[-overlap:] + "\n\n" + p).strip(), max(0, at - overlap)
    return out + ([(start, held)] if held else [])


@pytest.mark.parametrize("body", ["", "kurz", "A\n\nB", "A\n\n\n  B\n \nC", "x" * 2000, "x" * 900, "\n\n".join(f"Absatz {i} " + "wort " * (i * 7 % 90) for i in range(40)), "y" * 100 + "\n\n" + "z" * 1500 + "\n\n" + "w" * 950])
def test_pieces(body):
    assert list(texts._pieces(body)) == naive_pieces(body)


def test_sections_and_chunks(spark):
    text = "Vorspann.\n\n## Leer\n\n### Teil eins\n\nErster Absatz.\n\nZweiter.\n#### Teil zwei\nTeil zwei beginnt hier.\n##### kein Titel"
    assert [(h, b) for h, _, b in texts._sections(text)] == [("", "Vorspann."), ("Teil eins", "Erster Absatz.\n\nZweiter."), ("Teil zwei", "Teil zwei beginnt hier.\n##### kein Titel")]
    rows = texts.chunks(spark.createDataFrame([(7, text), (8, "  "), (9, None)], "id int, text string"), "id", "text").orderBy("id", "chunk_index").collect()
    assert [(r.chunk_id, r.total_chunks, r.section) for r in rows] == [("7-c0000", 3, ""), ("7-c0001", 3, "Teil eins"), ("7-c0002", 3, "Teil zwei")]
    assert [r.text for r in rows] == ["Vorspann.", "Teil eins\nErster Absatz.\n\nZweiter.", "Teil zwei beginnt hier.\n##### kein Titel"]
    assert all(0 <= r.char_start < r.char_end for r in rows) and (rows[1].char_start, rows[1].char_end) == (text.index("###"), text.index("###") + len("Erster Absatz.\n\nZweiter."))


GOOD = {"id": 1, "domain": "aid", "title_de": "Wohngeld beantragen", "summary_de": "Wer Wohngeld bekommt", "content_de": "Wohngeld ist ein Zuschuss. " * 10, "url": "https://a.example.org/wohngeld", "tier": "tier_1_official", "iqs": 80.0, "ais": 75.0}
GATE = [
    ({}, "accepted"), ({"title_de": "x" * 501}, "oversized_title"), ({"content_de": "x" * 500_001}, "oversized_content"), ({"title_de": None}, "low_signal_title"), ({"title_de": "Startseite"}, "low_signal_title"),
    ({"title_de": "Alle Meldungen"}, "domain_low_signal_title"), ({"title_de": "Alle Meldungen", "domain": "tools"}, "accepted"), ({"url": "https://a.example.org/Privacy"}, "low_signal_url"), ({"url": "https://a.example.org/mediathek/1"}, "domain_low_signal_url"),
    ({"summary_de": "Wir nutzen Matomo"}, "low_signal_content"), ({"tier": None}, "unknown_source_tier"), ({"content_de": "kurz"}, "thin_content"), ({"summary_de": "WOHNGELD beantragen"}, "summary_equals_title"), ({"iqs": None}, "iqs_below_threshold"), ({"iqs": 74.9}, "iqs_below_threshold"), ({"ais": 69.0}, "ais_below_threshold"),
    ({"iqs": None, "tier": "tier_unknown", "url": "https://a.example.org/tag/x"}, "low_signal_url"),
]


def test_candidate_gate(spark):
    rows = [tuple((GOOD | change | {"id": i}).values()) for i, (change, _) in enumerate(GATE)]
    frame = spark.createDataFrame(rows, "id int, domain string, title_de string, summary_de string, content_de string, url string, tier string, iqs double, ais double")
    assert [r.reason for r in frame.select("id", filters.candidate_gate(frame).alias("reason")).orderBy("id").collect()] == [reason for _, reason in GATE]


def test_low_signal(spark):
    rows = spark.createDataFrame([("https://a.example.org/PRESSE/1", "x"), ("https://a.example.org/x", "Herzlich willkommen"), (None, ""), ("", "Titel"), ("https://a.example.org/login", "Anmelden")], "url string, title string")
    assert [r[0] for r in rows.select(filters.low_signal(rows.url, rows.title)).collect()] == [True, True, True, False, False]
