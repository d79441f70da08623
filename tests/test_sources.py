from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scalemetrics.sources import artifacts, delimited, metric_csv, tables
from scalemetrics.spec import FIVE_DOMAIN as SPEC


def test_delimited_dirty_values_become_missing(spark, tmp_path):
    header = [i.upper() for i in SPEC.items] + ["country"]
    lines = ["\t".join(header), "\t".join(["3"] * 50 + ["FR"]), "\t".join(["x"] + ["4"] * 49 + ["DE"])]
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n")
    df = delimited.read_answers(spark, str(tmp_path / "a.tsv"), SPEC, header)
    assert sorted((r["ext1"] or 0, r["opn10"]) for r in df.collect()) == [(0, 4), (3, 3)]
    assert delimited.tidy(df, SPEC).columns == ["respondent_id", *SPEC.items, "country"]
    with pytest.raises(ValueError, match="ext1"):
        delimited.read_answers(spark, str(tmp_path / "a.tsv"), SPEC, header[1:])


def test_columns_are_found_by_the_files_own_header(spark, tmp_path):
    names = [i.upper() for i in SPEC.items]
    swapped = [names[1], names[0], *names[2:]]
    (tmp_path / "s.tsv").write_text("\t".join(swapped) + "\n" + "\t".join(["1", "2"] + ["3"] * 48) + "\n")
    row = delimited.read_answers(spark, str(tmp_path / "s.tsv"), SPEC).first()
    assert (row["ext1"], row["ext2"]) == (2, 1)
    (tmp_path / "short.tsv").write_text("\t".join(names[1:]) + "\n" + "\t".join(["3"] * 49) + "\n")
    with pytest.raises(ValueError, match="ext1"):
        delimited.read_answers(spark, str(tmp_path / "short.tsv"), SPEC)
    both = tmp_path / "both"
    both.mkdir()
    for n, header in enumerate((names, swapped)):
        (both / f"{n}.tsv").write_text("\t".join(header) + "\n" + "\t".join(["3"] * 50) + "\n")
    with pytest.raises(Exception, match="header"):
        delimited.read_answers(spark, str(both), SPEC).collect()


def test_generated_ids_do_not_depend_on_splits(spark, tmp_path):
    names = [i.upper() for i in SPEC.items]
    lines = ["\t".join([str(1 + n % 5)] * 50) for n in range(40)]
    (tmp_path / "a.tsv").write_text("\n".join(["\t".join(names), *lines]) + "\n")
    folder = tmp_path / "b"
    folder.mkdir()
    for n in range(4):
        (folder / f"{n}.tsv").write_text("\n".join(["\t".join(names), *lines[n::4]]) + "\n")
    ids = [sorted(r[0] for r in delimited.read_answers(spark, str(p), SPEC).select("respondent_id").collect()) for p in (tmp_path / "a.tsv", folder)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 40


def test_item_pool_in_both_spellings(spark, tmp_path):
    snake = {"item_pool": [{"id": "ext1", "rank": 1, "home_domain": "ext", "own_domain_r": 0.5, "domain_correlations": {"ext": 0.5}}]}
    camel = {"itemPool": [{"id": "ext1", "rank": 1, "homeDomain": "ext", "ownDomainR": 0.5, "domainCorrelations": {"ext": 0.5}}]}
    for name, doc in (("s", snake), ("c", camel)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    a, b = (artifacts.read_item_pool(spark, str(tmp_path / f"{n}.json")).collect() for n in "sc")
    assert a == b and a[0]["home_domain"] == "ext" and a[0]["domain_correlations"] == {"ext": 0.5}


def test_metric_file_must_keep_its_shape(spark, tmp_path):
    long = spark.createDataFrame([(5, "m", d, 0.5) for d in SPEC.domains], "k int, method string, domain string, value double")
    wide = metric_csv.wide_metrics(long, list(SPEC.domains))
    metric_csv.write_metrics(wide, str(tmp_path / "x"))
    schema = "k int, method string, " + ", ".join(f"r_{d} double" for d in SPEC.domains)
    assert metric_csv.read_metrics(spark, str(tmp_path / "x"), schema).count() == 1
    wide.union(wide).write.mode("overwrite").option("header", True).csv(str(tmp_path / "x" / "data"))
    with pytest.raises(ValueError, match="shape"):
        metric_csv.read_metrics(spark, str(tmp_path / "x"), schema)


def test_counted_write_and_split_pruning(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("respondent_id"), F.when(F.col("id") < 30, "test").otherwise("train").alias("split"))
    assert tables.write_counted(df, str(tmp_path / "t"), "split") == 100
    test = tables.read_split(spark, str(tmp_path / "t"), "test")
    assert test.count() == 30 and "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    first = tables.read_table(spark, str(tmp_path / "t"), ["respondent_id"], first=3)
    assert [r[0] for r in first.orderBy("respondent_id").collect()] == [0, 1, 2]


def test_item_documents_round_trip_in_both_spellings(spark, tmp_path):
    pool = spark.createDataFrame(
        [("ext1", 2, "ext", 0.5, 1.5, {"ext": 0.5, "agr": -0.1}, True), ("agr2", 1, "agr", 0.7, 2.5, {}, False)],
        "id string, rank int, home_domain string, own_domain_r double, cross_domain_info double, domain_correlations map<string,double>, is_reverse_keyed boolean",
    )
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    info = artifacts.ItemInfo(pool, one([("agr2", "I like \"people\"", "agr")], "id string, text string, domain string"), one([("ext", 0.25), ("agr", 0.3)], "domain string, r_bar double"), one([("sha", "ab"), ("at", "now")], "name string, value string"))
    for camel in (False, True):
        path = str(tmp_path / f"info-{camel}")
        artifacts.write_item_info(info, path, camel)
        back = artifacts.read_item_info(spark, path)
        for part in ("item_pool", "first_item", "inter_item_r_bar", "provenance"):
            want = getattr(info, part)
            assert sorted(map(repr, getattr(back, part).select(want.columns).collect())) == sorted(map(repr, want.collect())), (part, camel)


def test_item_documents_with_gaps_and_faults(spark, tmp_path):
    (tmp_path / "gaps.json").write_text('{"item_pool": [{"id": "opn12", "rank": 1}], "first_item": {"id": "opn12"}, "interItemRBar": {"opn": 0.2}}')
    back = artifacts.read_item_info(spark, str(tmp_path / "gaps.json"))
    row = back.item_pool.first()
    assert (row.home_domain, row.own_domain_r, row.cross_domain_info, row.is_reverse_keyed, row.domain_correlations) == ("opn", 0.0, 0.0, False, {})
    assert tuple(back.first_item.first()) == ("opn12", "", "") and back.inter_item_r_bar.first().r_bar == 0.2 and back.provenance.count() == 0
    (tmp_path / "none.json").write_text('{"first_item": {"id": "opn12"}}')
    (tmp_path / "nan.json").write_text('{"itemPool": [{"id": "a1", "rank": 1, "ownDomainR": NaN}]}')
    for name, message in (("none", "no pool"), ("nan", "finite")):
        with pytest.raises(Exception, match=message):
            artifacts.read_item_info(spark, str(tmp_path / f"{name}.json")).item_pool.collect()
