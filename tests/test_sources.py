import json
import tempfile

import pytest
from pyspark.sql import functions as F

from touchline.sources import catalog as C, ingest as I, pages as P, payloads as J, tables as T


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="touchline-test-")


def rows(spark, start, n, league="EPL", season="2024-2025"):
    return spark.range(start, start + n).select(
        F.col("id").alias("match_id"), F.lit(league).alias("competition"), F.lit(season).alias("season"), F.lit(1.0).alias("goals")
    )


def test_partitioned_read_prunes_and_projects(spark, folder):
    both = rows(spark, 0, 3).unionByName(rows(spark, 10, 2, "La_Liga", "2023-2024"))
    both.write.partitionBy("competition", "season").parquet(f"{folder}/c/player_stats")
    df = T.load_c(spark, folder, "player_stats", "esp", "2023-2024", ["match_id", "goals"])
    assert (df.columns, df.count()) == (["match_id", "goals"], 2)
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(competition" in plan
    assert T.available_seasons(spark, folder, "player_stats") == ["2024-2025", "2023-2024"]
    with pytest.raises(ValueError, match="2023-2024"):
        T.load_c(spark, folder, "player_stats", "ESP", "1999-2000")
    assert T.load_top_leagues(spark, folder).select("league").distinct().count() == 2
    assert T.query_table(spark, folder, "c", "player_stats", "SELECT count(*) AS n FROM {table}").first().n == 5


def test_bad_column_names_are_refused():
    with pytest.raises(ValueError):
        T.check_columns(["goals; DROP TABLE x"])
    assert T.equal_to({"a": None}) is None


def test_append_only_unseen(spark, folder):
    path = f"{folder}/t"
    I.append_unseen(rows(spark, 0, 4), path, ["match_id"], ["competition", "season"])
    I.append_unseen(rows(spark, 2, 4), path, ["match_id"], ["competition", "season"])
    stored = spark.read.parquet(path)
    assert sorted(r.match_id for r in stored.collect()) == list(range(6))
    assert I.partition_report(stored, partitions=["competition", "season"]).first().n_matches == 6
    I.consolidate([stored, stored.withColumn("extra", F.lit(1))], f"{folder}/all")
    assert spark.read.parquet(f"{folder}/all").where("extra is null").count() == 6


def test_append_keeps_rows_of_a_split_match(spark, folder):
    path, parts = f"{folder}/split", ["competition", "season"]
    two = rows(spark, 1, 2)
    I.append_unseen(two, path, ["match_id"], parts)
    late = rows(spark, 2, 1).withColumn("goals", F.lit(99).cast(two.schema["goals"].dataType))
    assert I.append_unseen(late, path, ["match_id"], parts).count() == 1
    assert I.append_unseen(late, path, ["match_id"], parts).count() == 0
    assert spark.read.parquet(path).count() == 3


def test_season_labels_stay_text_and_a_schema_is_applied(spark, folder):
    rows(spark, 0, 2).drop("season").withColumn("season", F.lit(2024)).write.partitionBy("season").parquet(f"{folder}/a/summary")
    df = T.read_table(spark, folder, "a", "summary", filters={"season": "2024"})
    assert dict(df.dtypes)["season"] == "string" and df.count() == 2
    schema = df.select("match_id", "season").schema
    assert T.read_table(spark, folder, "a", "summary", schema=schema).schema.fieldNames() == ["match_id", "season"]


def test_skipped_files_by_full_path(spark, folder):
    import os

    frame = rows(spark, 0, 2)
    for name in ("x", "y"):
        os.makedirs(f"{folder}/{name}")
        frame.toPandas().to_parquet(f"{folder}/{name}/same.parquet")
    frame.toPandas().head(0).to_parquet(f"{folder}/empty.parquet")
    with open(f"{folder}/y/same.parquet", "wb") as f:
        f.write(b"no parquet")
    paths = [f"{folder}/x/same.parquet", f"{folder}/y/same.parquet", f"{folder}/empty.parquet"]
    assert I.skipped_files(spark, paths, frame.schema) == [paths[1]]


def test_file_stream_appends_unseen(spark, folder):
    from touchline.streaming.ingest import stream_unseen

    rows(spark, 0, 4).write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    run = lambda: stream_unseen(spark, f"{folder}/in", schema, f"{folder}/out", f"{folder}/cp", partitions=["competition", "season"]).awaitTermination(60)
    run()
    rows(spark, 3, 3).write.mode("append").parquet(f"{folder}/in")
    run()
    assert sorted(r.match_id for r in spark.read.parquet(f"{folder}/out").collect()) == list(range(6))


def test_manifest(spark, folder):
    meta = rows(spark, 5, 3).withColumnRenamed("competition", "league")
    I.save_manifest(I.build_manifest(meta), f"{folder}/m")
    leagues = spark.createDataFrame([("EPL",), ("RFPL",)], "league string")
    got = {r.league: r.max_id for r in I.high_water_marks(I.load_manifest(spark, f"{folder}/m"), leagues).collect()}
    assert got == {"EPL": 7, "RFPL": None}
    assert I.load_manifest(spark, f"{folder}/none").count() == 0


def test_catalog(spark, folder):
    entry = {"name": "Premier League", "country": "England", "type": "league", "tier": 1, "n_matches": 380, "seasons": ["2023-2024", "2024-2025"]}
    with open(f"{folder}/catalog.json", "w") as f:
        json.dump({"competitions": {"EPL": entry, "A_League": {**entry, "name": "A-League", "tier": 2}}, "aliases": {"AUS": "A_League"}}, f)
    cat = C.read_catalog(spark, f"{folder}/catalog.json")
    assert [r.code for r in C.list_leagues(cat, ["league"], 1).collect()] == ["EPL"]
    assert [r.season for r in C.list_seasons(cat, "EPL").collect()] == ["2024-2025", "2023-2024"]
    assert (C.feed_league("eng"), C.feed_league("la_liga"), C.feed_league("aus", cat)) == ("EPL", "La_Liga", "A_League")
    with pytest.raises(ValueError):
        C.feed_league("nowhere")
    assert C.is_tournament("WC") and not C.is_tournament("ENG") and C.code_of_label_b("La liga") == "ESP"
    assert C.competitions(spark, "european").count() == 2


def test_timeline(spark):
    html = (
        '<div class="timeline-item timeline-item-right"><div class="timeline-time"><span>12\'</span></div><div class="timeline-content">'
        '<i class="fa-futbol"></i><a class="timeline-player-name" href="/player/55">Ann</a><span class="timeline-match-score">0 - 1</span></div></div>'
    )
    rec = P.extract_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), timeline=True).first()
    got = json.loads(rec.record)
    assert (got["minute"], got["team_side"], got["player_id"], got["score"]) == ("12", "away", "55", "0 - 1")


def test_snake_case():
    assert [J.snake_case(n) for n in ("xGChain", "player_id", "shotType", "h_a")] == ["x_g_chain", "player_id", "shot_type", "h_a"]


def match_page(team="0000abcd", extra=""):
    row = "<tr><th>Ann</th><td>90</td><td>8&lt;9</td></tr>"
    return (
        '<div class="scorebox"><div id="sb_team_0"><strong><a href="/t">A &amp; B</a></strong><div class="score"> 2 </div><div class="datapoint">Manager: Bo</div>'
        '<div class="datapoint">Captain: <a href="/players/0000dcba/x">Cy</a></div></div><div id="sb_team_1"><strong><a>Away</a></strong><div class="score">x</div></div>'
        '<div class="scorebox_meta"><span class="venuetime" data-venue-time="20:00">8</span><div>Venue: <b>Old</b> Park</div><div>Officials: D E (Referee) · F (VAR)</div></div></div>'
        '<div class="lineup" id="b"><table><tr><th>Away (4-3-3)</th></tr></table></div>'
        '<div id="events_wrap"><div class="event a"><div>90+2&rsquor;<br> <small><span>1:0</span></small></div><div class="event_icon goal"/><a href="/x/0000abcd/">Ann</a><small>Assist: <a>Di</a></small></div>'
        '<div class="event"><div>7&rsquor;</div><i class="event_icon red_card"></i></div><div class="event"><i class="event_icon other"></i></div></div>'
        f'<table id="stats_{team}_summary"><thead><tr><th>G</th></tr><tr><th>Player</th><th>Min</th><th>Min</th></tr></thead><tbody>{row}<tr class="thead"><th>x</th></tr><tr><td>1</td></tr></tbody></table>'
        f'<table id="keeper_stats_{team}"><thead><tr><th>team</th><th>1/3</th></tr></thead><tbody><tr><td>own</td><td><b>4</b>5</td></tr></tbody></table>{extra}'
    )


ODD = ["<!-- <tr> -->", "<script>a<b</script>", "<p>open", "</div>", "a > b", "&amp", '<i title="a>b">c</i>', "<", "<textarea>x</textarea><div/>", "<DIV CLASS=score>3</DIV>", "é&#8217;"]


def test_pages_by_arrays_equal_pages_by_trees():
    import pyarrow as pa

    from touchline.sources import page_arrays as A

    pages = [match_page(), "", None, "x", match_page("00000001"), *(match_page(extra=x) for x in ODD), *(x + match_page("0000000f") for x in ODD)]
    urls = [f"https://x/{i:08x}/A-B-{'August-17-2024' if i % 2 else 'Mai-99-2024'}" for i in range(len(pages))]
    want = [(p, t, i, json.dumps(r, ensure_ascii=False)) for p, (h, u) in enumerate(zip(pages, urls)) for i, (t, r) in enumerate(P.page_records(h, u))]
    for most in (A.BYTES, 3_000):
        got = []
        for start, n in A.pieces(pa.array(pages), most):
            page, *rest = A.batch_records(urls[start : start + n], pa.array(pages).slice(start, n))
            got += list(zip((page + start).tolist(), *rest))
        assert got == want


def test_plain_pages_build_no_tree(monkeypatch):
    import pyarrow as pa

    from touchline.sources import page_arrays as A

    monkeypatch.setattr(P, "page_records", None)
    table = A.batch_records(["u"], pa.array([match_page()]))[1]
    assert table == ["metadata", "summary", "keeper", "events", "events"]


@pytest.mark.parametrize("name", ["match_page_metadata", "match_page_events", "match_page_stats"])
def test_pages_are_not_shuffled(spark, data, name):
    from touchline.queries import all_queries

    plan = all_queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Repartition" in line]
    assert len(dealt) == 1 and "l_orderkey" in dealt[0] and plan.index("html") < plan.index("Repartition")
