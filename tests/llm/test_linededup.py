from collections import Counter

from vexil.llm import linededup as ld


def test_documents_against_brute_force(spark):
    """Documents of equal text count once; a line goes if it is on two or more of a source's texts and on more than the ratio of them."""
    rows = [(i, f"own {i}\n{'menu' if i % 2 else 'other'}\nfooter\nown {i}", "s" if i < 14 else None, 9) for i in range(20)]
    rows += [(90, None, "s", None), (91, "", "s", 0), (92, "footer", "t", 6), (93, "footer", "t", 6), (94, "a\nmenu", "u", 6), (95, "b\nmenu", "u", 6), (95, "b\nmenu", "u", 6)]
    rows += [(100 + i, "the same\ntext", "s", 13) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    texts = {(r[2], r[1]) for r in rows}
    pages, seen = Counter(s for s, _ in texts), Counter((s, line) for s, t in texts if t is not None for line in set(t.split("\n")))
    drop = {k for k, n in seen.items() if n > 1 and n > ld.RATIO * pages[k[0]]}
    out = ld.clean_documents(df)
    assert out.columns == df.columns and out.schema == df.schema
    got = {r["doc_id"]: r for r in out.collect()}
    for i, text, source, _ in rows:
        want = None if text is None else "\n".join(x for x in text.split("\n") if (source, x) not in drop)
        assert got[i]["text"] == want
    assert got[92]["text"] == "footer" and ("s", "footer") in drop and got[0]["n_chars"] == len(got[0]["text"])
    assert got[94]["text"] == "a" and got[100]["text"] == "the same\ntext" and out.count() == len(rows)


def test_pages(spark):
    html = "<script>var a='<p>';</script><nav><ul><li>Home</li></ul></nav><p>Text {}</p><!-- x --><footer>Foot</footer>"
    df = spark.createDataFrame([(i, f"https://Host.example/{i}", html.format(i)) for i in range(8)] + [(9, None, None), (10, "http://b.example?x", "<p>Home<br>Foot")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in ld.clean_pages(df).collect()}
    assert got[3]["site"] == "host.example" and list(got[3]["kept_lines"]) == ["Text 3"] and list(got[10]["kept_lines"]) == ["Home", "Foot"] and got[9]["lines"] is None


def test_small_hosts_clashing_names_repeated_ids_and_a_long_page(spark):
    """A host of four pages loses its menu line; a line of its own stays on a host of one page."""
    long = "<p>" + "y" * 300_000 + "</p>" + "<p>z</p>" * 2000
    rows = [(i, f"http://four/{i}", f"<p>Menu</p><p>Own {i}</p>", "keep", 7, None) for i in range(4)]
    rows += [(9, "http://one/", "<p>Menu</p>", "keep", 8, 1), (10, "http://two/a", long, "keep", 9, 2), (10, "http://two/a", long, "keep", 9, 2), (None, None, "", "keep", 1, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, site string, lines int, _drop int")
    out = ld.clean_pages(df)
    assert out.columns == [*df.columns, "site_2", "lines_2", "kept_lines"] and {r["site"] for r in out.collect()} == {"keep"}
    got = {(r["page_id"], r["_drop"]): r for r in out.collect()}
    assert list(got[2, None]["kept_lines"]) == ["Own 2"] and list(got[9, 1]["kept_lines"]) == ["Menu"] and list(got[None, 1]["kept_lines"]) == []
    assert len(got[10, 2]["lines_2"]) == 2001 and list(got[10, 2]["kept_lines"]) == [] and out.count() == len(rows)
    assert ld.clean_pages(df.limit(0)).count() == 0


def test_empty(empty):
    assert ld.clean_documents(empty).count() == 0
