"""Every pN_ query runs over the smallest tables with the stated columns."""

import pytest

from codexmill.llm.queries import queries

COLUMNS = {
    "p1_found": ["page_id", "split"], "p2_found": ["line_id", "annotator"], "p4_found": ["line_id_a", "line_id_b"], "p5_found": ["line_id", "kind"],
    "p6_found": ["line_id", "engine"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id"], "p9_found": ["doc_id", "end_pos"],
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, small, name):
    df = queries()[name](spark, small)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len({str(r) for r in rows})


def test_found_is_part_of_the_splits(spark, small):
    all_ = {r["page_id"]: r["split"] for r in queries()["p1_splits"](spark, small).collect()}
    found = {r["page_id"]: r["split"] for r in queries()["p1_found"](spark, small).collect()}
    assert found and found.items() <= all_.items() and set(found.values()) <= {"test", "val"}


def test_p6_against_a_plain_loop(spark, small):
    from codexmill.llm.scripts import look

    truth = {r["line_id"]: r["text_normalised"] for r in spark.read.parquet(f"{small}/consensus_lines.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{small}/engine_pages.parquet").select("engine", "lines").collect():
        for x in r["lines"] or []:
            t = truth.get(x["line_id"])
            if x["text"] and t and x["text"] != t and look(x["text"]) == look(t):
                want.add((x["line_id"], r["engine"]))
    assert {tuple(r) for r in queries()["p6_found"](spark, small).collect()} == want and want


def test_p4_against_all_pairs(spark, small):
    from codexmill.llm import queries as Q

    rows = Q._split_lines(spark, small).collect()
    train, other = ([r for r in rows if (r["split"] == "train") == k] for k in (True, False))

    def near(a, b):
        k = max(len(a), len(b)) // 5
        if abs(len(a) - len(b)) > k:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            if min(new) > k:
                return False
            row = new
        return row[-1] <= k

    want = {tuple(sorted((a["line_id"], b["line_id"]))) for a in other for b in train if near(a["form"], b["form"])}
    assert {tuple(r) for r in queries()["p4_found"](spark, small).collect()} == want


def test_p6_forms_of_both_sources(spark, small):
    from codexmill.llm.keys import book_key, key_of_page
    from codexmill.llm.scripts import in_form

    read = lambda t: spark.read.parquet(f"{small}/{t}.parquet").collect()
    configs = {r["config_id"]: r["unicode_form"] for r in read("pipeline_configs")}
    form = {book_key(r["book_id"]): configs[r["config_id"]] for r in read("books") if r["config_id"] in configs}
    of = lambda r, t: in_form(t, form.get(book_key(r["book_id"]) or key_of_page(r["page_id"])))
    want = {(r["line_id"], None, None, None, of(r, r["text_normalised"])) for r in read("consensus_lines")}
    want |= {(x["line_id"], r["engine"], r["output_id"], i, of(r, x["text"])) for r in read("engine_pages") for i, x in enumerate(r["lines"] or [], 1)}
    got = [tuple(r) for r in queries()["p6_forms"](spark, small).collect()]
    assert set(got) == want and len(got) == len(want)
