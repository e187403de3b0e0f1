"""Queries over cleaning, names, seasons, ingest and page extraction."""

from pyspark.sql import functions as F

from touchline.functions import names as N, numeric as U, seasons as SE
from touchline.operators import clean as C, design as D, ranking as K, ratings as RT, ridge as RG, validate as V
from touchline.queries import lineups_and_segments as LS
from touchline.queries.forecasts import RES
from touchline.queries.roles import rounded, table
from touchline.sources import catalog as CA, ingest as I, pages as P, payloads as J, tables as T


def _case(mapping: dict, column: str, default: str) -> str:
    arms = " ".join(f"WHEN {k!r} THEN '{v}'" if isinstance(k, str) else f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE '{default}' END"


TEAMS = {0: "Man City", 1: " Spurs ", 2: "Wolves", 3: "Arsenal", 4: "Leeds"}
CLEAN = {0: "Manchester City", 1: "Tottenham Hotspur", 2: "Wolverhampton Wanderers", 3: "Arsenal", 4: "Leeds United"}
_T = lambda c: _case(TEAMS, f"{c} % 6", "Everton")
_C = lambda c: _case(CLEAN, f"{c} % 6", "Everton")


def player_names(spark, folder):
    c = table(spark, folder, "customer")
    raw = F.concat(F.lit("  "), F.upper("c_mktsegment"), F.lit("   "), "c_name", F.when(F.col("c_custkey") % 3 == 0, " Jr.").otherwise(""))
    href = F.concat(F.lit("/players/"), F.lower(F.lpad(F.hex("c_custkey"), 8, "0")), F.lit("/x"))
    return c.select(
        "c_custkey", N.player_display_name(raw).alias("display"), N.player_key(raw).alias("key"),
        N.player_slug(raw, F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.col("c_custkey").cast("string"))).alias("slug"),
        N.player_id_from_href(href).alias("link_id"), N.initial_form_column(F.trim(F.lower(raw))).alias("initial"),
        N.strip_accents(F.concat(F.lit("Zoë é"), "c_name")).alias("plain"),
    )


def team_names(spark, folder):
    spark_case = F.expr(_T("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey", N.team_name(spark_case).alias("team"))


def season_labels(spark, folder):
    o = table(spark, folder, "orders").withColumn("d", F.to_date("o_orderdate"))
    key = N.match_key(SE.season_of_date("d"), "d", F.col("o_orderstatus"), F.col("o_orderpriority"))
    o = o.withColumn("key", key)
    return o.select(
        "o_orderkey", "key", SE.season_of_match_key("key").alias("season"), SE.season_end_year_of_match_key("key").alias("end_year"),
        SE.season_end_year(SE.season_of_date("d")).alias("end_year_label"), SE.season_end_year_of_date("d").alias("end_year_date"),
        SE.start_year_label(SE.season_of_date("d")).alias("start_year"), SE.full_season_label(F.year("d").cast("string")).alias("full_label"),
        SE.season_of_url(F.concat(F.lit("/x/"), SE.season_of_date("d"), F.lit("/y"))).alias("url_season"),
    )


def clock_texts(spark, folder):
    li = table(spark, folder, "lineitem")
    text = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("+"), F.col("l_linenumber").cast("string"))).otherwise(F.col("l_quantity").cast("int").cast("string"))
    minute, added = SE.clock_parts(text)
    out = li.select(text.alias("text"), minute.alias("minute"), added.alias("added"), SE.clock_decimal(text).alias("decimal"))
    return rounded(out.groupBy("text", "minute", "added", "decimal").agg(F.count(F.lit(1)).alias("n")))


def safe_rates(spark, folder):
    li = table(spark, folder, "lineitem")
    x, y = F.col("l_linenumber"), F.col("l_suppkey") % 4
    out = li.select("l_partkey", U.safe_divide(x, y).alias("ratio"), U.safe_divide(x, y, -1.0).alias("flagged"), U.per_90(x, y).alias("rate"))
    return rounded(out.groupBy("l_partkey").agg(*[F.sum(c).alias(c) for c in ("ratio", "flagged", "rate")]), 4)


def league_codes(spark, folder):
    o = table(spark, folder, "orders")
    league = F.when(F.col("o_orderstatus") == "O", "eng").when(F.col("o_orderstatus") == "F", "LA_liga").otherwise("Serie_A")
    return CA.feed_codes(o.withColumn("league", league)).groupBy("competition").agg(F.count(F.lit(1)).alias("n"))


def filtered_scan(spark, folder):
    o = table(spark, folder, "orders")
    return o.where(T.equal_to({"o_orderstatus": "F", "o_custkey": None, "o_orderpriority": "5-LOW"})).select(
        *T.check_columns(["o_orderkey", "o_totalprice"])
    )


def season_listing(spark, folder):
    o = table(spark, folder, "orders").withColumn("season", SE.season_of_date("o_orderdate"))
    return T.seasons_of(o, o_orderstatus="F")


def column_union(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    s = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), "s_nationkey")
    return I.union_by_name([c, s])


def unseen_matches(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("match_id"), "o_orderstatus")
    seen = table(spark, folder, "lineitem").where(F.col("l_returnflag") == "A").select(F.col("l_orderkey").alias("match_id"))
    return I.unseen(o, seen, ["match_id"])


def partition_report(spark, folder):
    li = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.col("l_returnflag").alias("league"), F.col("l_linestatus").alias("season")
    )
    return I.partition_report(li)


def ingested_keys(spark, folder):
    o = table(spark, folder, "orders")
    first = o.select(F.col("o_orderstatus").alias("league"), F.year("o_orderdate").alias("season"), F.col("o_orderkey").alias("match_id"))
    second = first.where(F.col("season") > 1998)
    return I.known_keys(first, second)


def _metadata(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderstatus").alias("league"), F.year("o_orderdate").alias("season"),
        F.col("o_orderdate").cast("timestamp").alias("scraped_at"),
    )


def manifest(spark, folder):
    return I.build_manifest(_metadata(spark, folder)).withColumn("scraped_at", F.date_format("scraped_at", "yyyy-MM-dd"))


def high_water_marks(spark, folder):
    leagues = table(spark, folder, "lineitem").select(F.col("l_linestatus").alias("league")).unionByName(
        table(spark, folder, "region").select(F.col("r_name").alias("league"))
    )
    return I.high_water_marks(I.build_manifest(_metadata(spark, folder)), leagues)


def available_tables(spark, folder):
    li = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "match_id")
    out = I.tables_available(
        _metadata(spark, folder),
        {"summary": li.where("l_returnflag = 'A'"), "shots": li.where("l_returnflag = 'N'"), "events": li.where("l_linestatus = 'F'")},
    )
    return out.select("match_id", "tables_available")


def null_profile(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return V.completeness(joined, ["doc_id", "no_such_column"])


def season_coverage(spark, folder):
    o = table(spark, folder, "orders").withColumn("season_end_year", F.year("o_orderdate"))
    li = table(spark, folder, "lineitem").withColumn("season_end_year", F.year("l_shipdate"))
    return V.season_coverage({"orders": o, "lineitem": li})


def _raw_results(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(
        F.concat(F.lit("/m/"), "o_orderkey").alias("match_url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.expr(_T("o_custkey")).alias("home"), F.expr(_T("o_orderkey")).alias("away"),
        (F.col("o_custkey") % 4).cast("string").alias("home_goals"), (F.col("o_orderkey") % 3).cast("string").alias("away_goals"),
        F.when(F.col("o_custkey") % 5 == 0, "n/a").otherwise(F.round(F.col("o_totalprice") / 300000, 3).cast("string")).alias("home_x_g"),
        F.lit("1.25").alias("away_x_g"), F.year("o_orderdate").alias("season_end_year"), F.col("o_orderstatus").alias("league"),
    )


def clean_results(spark, folder):
    out = C.clean_results(_raw_results(spark, folder))
    return rounded(out.drop("date", "season"))


def _raw_lines(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.select(
        F.concat(F.lit("/m/"), "l_orderkey").alias("match_url"), F.concat(F.lit(" mr "), "l_partkey", F.lit("  III")).alias("player"),
        F.expr(_T("l_suppkey")).alias("squad"), F.when(F.col("l_linestatus") == "O", "Home").otherwise("Away").alias("home_away"),
        F.col("l_quantity").cast("string").alias("min"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("/players/"), F.lpad("l_partkey", 8, "0"), F.lit("/z"))).alias("player_href"),
        F.lit("FW").alias("pos"), (F.col("l_linenumber") % 3).cast("string").alias("gls"), F.col("l_discount").cast("string").alias("x_g"),
        F.col("l_discount").cast("string").alias("npx_g"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, "+3").otherwise("")).alias("minute"),
        F.when(F.col("l_returnflag") == "A", "Goal").otherwise("Saved").alias("outcome"),
        F.when(F.col("l_suppkey") % 7 == 0, "PENALTY kick").when(F.col("l_suppkey") % 7 == 1, "own goal").alias("notes"), F.lit("Head").alias("body_part"),
        F.when(F.col("l_returnflag") == "A", "Goal").when(F.col("l_returnflag") == "R", "Substitute").when(F.col("l_tax") > 0.06, "red card").otherwise("Yellow").alias("event_type"),
        F.col("l_linenumber").alias("sheet_order"), (F.col("l_linestatus") == "O").alias("is_home"),
    )


def clean_lineups(spark, folder):
    out = C.clean_lineups(_raw_lines(spark, folder).drop("is_home"), C.clean_results(_raw_results(spark, folder)))
    return out.groupBy("player_name", "player_id", "team", "is_home").agg(
        F.count("match_id").alias("n"), F.sum("minutes").alias("minutes"), F.count_if("is_starter").alias("starts")
    )


def clean_events(spark, folder):
    raw = _raw_lines(spark, folder).drop("is_home").withColumn("minute", F.col("sheet_order"))
    out = C.clean_events(raw, C.clean_results(_raw_results(spark, folder)))
    return out.groupBy("event_type", "team", "is_home", "is_penalty").agg(F.count(F.lit(1)).alias("n"), F.sum("minute").alias("minutes"))


def clean_shots(spark, folder):
    out = C.clean_shots(_raw_lines(spark, folder), C.clean_results(_raw_results(spark, folder)))
    return rounded(out.groupBy("team", "is_goal", "is_penalty").agg(F.count("match_id").alias("n"), F.sum("minute").alias("minutes"), F.sum("added_time").alias("added"), F.sum("xg").alias("xg")), 4)


def clean_stats(spark, folder):
    out = C.clean_stats(_raw_lines(spark, folder).drop("is_home"), C.clean_results(_raw_results(spark, folder)), "summary")
    return rounded(out.groupBy("player_name", "is_home").agg(F.sum("min").alias("min"), F.sum("gls").alias("gls"), F.sum("x_g").alias("x_g")), 4)


def events_from_shots(spark, folder):
    raw = _raw_lines(spark, folder).withColumn("minute", F.col("sheet_order"))
    out = C.events_from_shots(raw)
    return out.groupBy("match_url", "is_penalty", "is_own_goal").agg(F.count(F.lit(1)).alias("n"), F.max("minute").alias("last"))


def lineups_from_stats(spark, folder):
    out = C.lineups_from_stats(_raw_lines(spark, folder).withColumnRenamed("squad", "team"))
    return out.groupBy("match_url", "is_home").agg(F.count_if("is_starter").alias("starters"), F.sum("minutes").alias("minutes"))


def seasons_by_url(spark, folder):
    seasons = _raw_results(spark, folder).select("match_url", "season_end_year")
    out = C.with_season(_raw_lines(spark, folder), seasons)
    return out.groupBy("season_end_year").agg(F.count(F.lit(1)).alias("n"))


def match_xg_from_stats(spark, folder):
    meta = _raw_results(spark, folder).select("match_url", F.concat_ws("-", F.col("season_end_year") - 1, "season_end_year").alias("season"))
    return rounded(C.match_xg_from_stats(_raw_lines(spark, folder), meta))


def substitution_slots(spark, folder):
    """Team sheets: lines of an order in line order, later lines replace earlier ones."""
    li = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    sheet = li.select(
        F.col("l_orderkey").alias("match_url"), F.lit("T").alias("team"), F.col("l_linenumber").alias("sheet_order"),
        F.when(F.col("l_linenumber") % 3 == 0, " Sub").otherwise("Starter").alias("player"), F.col("q").alias("min"),
    ).withColumn("player", F.regexp_replace("player", "^ ", " "))
    out = C.substitution_chains(sheet)
    return out.select("match_url", "sheet_order", "is_starter", "player_name", "on_minute", "off_minute")


def columns_renamed(spark, folder):
    df = table(spark, folder, "supplier").select(F.col("s_name").alias("squad"), F.col("s_suppkey").alias("playerId"), F.col("s_acctbal").alias("minsPlayed"))
    df = C.ensure_column(C.canonical_columns(df), "is_first", source="team", pattern="SUPPLIER#0+1")
    return C.clean_column_names(df.withColumnRenamed("minutes", "MinsPlayed Total"))


def _match_pages(spark, folder):
    """One small match page per line item, built from its columns; the columns are dealt out, not the pages."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag").repartition("l_orderkey")
    team = F.lpad(F.lower(F.hex("l_suppkey")), 8, "0")
    html = F.concat(
        F.lit('<div class="scorebox"><div id="sb_team_0"><strong><a href="/t">Home &amp; '), "l_returnflag", F.lit('</a></strong><div class="score">'), F.col("l_linenumber").cast("string"),
        F.lit('</div><div class="datapoint">Manager: Boss '), F.col("l_suppkey").cast("string"), F.lit('</div></div><div id="sb_team_1"><strong><a>Away</a></strong><div class="score">2</div></div></div>'),
        F.lit('<div id="events_wrap"><div class="event a"><div>'), F.col("l_quantity").cast("int").cast("string"), F.lit("+2&rsquor; <small><span>1:0</span></small></div>"),
        F.lit('<div class="event_icon goal"></div><a href="/players/0000abcd/x">Scorer</a><small>Assist: <a href="/players/0000dcba/y">Helper</a></small></div></div>'),
        F.lit('<table id="stats_'), team, F.lit('_summary"><thead><tr><th>Group</th></tr><tr><th>Player</th><th>Min</th><th>Cmp%</th></tr></thead><tbody><tr><th>P'),
        F.col("l_partkey").cast("string"), F.lit("</th><td>"), F.col("l_quantity").cast("int").cast("string"),
        F.lit('</td><td>9</td></tr><tr class="spacer"><td>x</td></tr><tr><td>short</td></tr></tbody></table>'),
    )
    url = F.concat(F.lit("https://example.com/matches/"), F.lpad(F.lower(F.hex("l_orderkey")), 8, "0"), F.lit("/A-B-August-17-2024"))
    return li.select(F.col("l_orderkey").alias("page_id"), url.alias("url"), html.alias("html"))


def match_page_metadata(spark, folder):
    out = P.page_table(P.extract_pages(_match_pages(spark, folder)), "metadata", ["source_id", "match_date", "home_team", "home_score", "away_score", "home_team_id", "home_manager"])
    return out.drop("position", "url").groupBy(*[c for c in out.columns if c not in ("position", "url")]).agg(F.count(F.lit(1)).alias("n"))


def match_page_events(spark, folder):
    out = P.page_table(P.extract_pages(_match_pages(spark, folder)), "events", ["minute", "added_time", "event_type", "is_home", "player_id", "secondary_player", "score_home"])
    return out.groupBy("minute", "added_time", "event_type", "is_home", "player_id", "secondary_player", "score_home").agg(F.count(F.lit(1)).alias("n"))


def match_page_stats(spark, folder):
    out = P.page_table(P.extract_pages(_match_pages(spark, folder)), "summary", ["player", "min", "cmp_percent", "team", "is_home"])
    return out.groupBy("player", "team", "is_home", "cmp_percent").agg(F.sum(F.col("min").cast("int")).alias("minutes"))


def web_page_records(spark, folder):
    """The given web pages through the same extraction: every page gives its metadata record."""
    records = P.extract_pages(table(spark, folder, "pages"), partitions=spark.sparkContext.defaultParallelism)
    return P.page_table(records, "metadata", ["source_id", "home_team"]).select("page_id", "source_id", "home_team")


def _payloads(spark, folder):
    li = table(spark, folder, "lineitem")
    record = F.concat(F.lit('{"id": "'), "l_linenumber", F.lit('", "player": "p'), "l_partkey", F.lit('", "xG": "'), F.col("l_discount").cast("string"), F.lit('", "xGChain": null}'))
    roster = F.concat(F.lit('{"h": {"1": '), record, F.lit('}, "a": {"2": '), record, F.lit(', "3": '), record, F.lit("}}"))
    shots = F.concat(F.lit('{"h": ['), record, F.lit('], "a": []}'))
    return li.select(
        F.col("l_orderkey").alias("match_id"), F.concat(F.lit('{"rosters": '), roster, F.lit(', "shots": '), shots, F.lit("}")).alias("payload")
    )


def payload_rosters(spark, folder):
    out = J.rosters(_payloads(spark, folder))
    return out.groupBy("match_id", "player", "is_home").agg(F.count(F.lit(1)).alias("n"), F.count("x_g_chain").alias("chains"), F.max("x_g").alias("x_g"))


def payload_shots(spark, folder):
    out = J.shots(_payloads(spark, folder), key="match_id")
    return out.groupBy("match_id", "is_home").agg(F.count(F.lit(1)).alias("n"), F.max("x_g").alias("x_g"))


def embedded_match_info(spark, folder):
    o = table(spark, folder, "orders")
    body = F.concat(F.lit(r"\x7B\x22team_h\x22:\x22"), "o_orderpriority", F.lit(r"\x22,\x22h_goals\x22:\x22"), F.col("o_custkey") % 5, F.lit(r"\x22,\x22a_xg\x22:\x221.5\x22\x7D"))
    html = F.concat(F.lit("<script>var match_info = JSON.parse('"), body, F.lit("');</script>"))
    out = J.match_metadata(o.select(F.col("o_orderkey").alias("match_id"), html.alias("html")))
    return out.select("match_id", "home_team", "home_score", "away_xg", "away_score")


def _design(spark, folder):
    seg = LS.built(spark, folder)
    from touchline.operators.segments import assign_players

    players = assign_players(seg, LS.lineups(spark, folder))
    return D.design_rows(seg, players, min_minutes=2000, include_league=True, include_season=False)


def design_rows(spark, folder):
    rows = _design(spark, folder).rows
    return rounded(
        rows.select("row_id", "match_id", "y", "weight", "gd", "abs_goals", "avg_min", "is_home", "net_players", "abs_reds", F.size("tokens").alias("n_features"))
    )


def design_minutes(spark, folder):
    return rounded(_design(spark, folder).player_map)


def ridge_cross_products(spark, folder):
    """The sums the ridge is solved from, over all folds, by column pair kind."""
    d = _design(spark, folder)
    sums = RG.gram_sums(d.rows, d.covariates, n_folds=5)
    numeric = sums.where(~F.col("i").rlike("_off|_def|league_") & ~F.col("j").rlike("_off|_def|league_"))
    return numeric.groupBy("i", "j").agg((F.round(F.sum("s") / 1000, 4) + F.lit(0.0)).alias("s"))


def _token_rows(spark, folder):
    """Order lines as ridge rows: two 0/1 features, weights, matches of four lines or so."""
    li = table(spark, folder, "lineitem")
    on = lambda flag, name: F.when(F.col("l_returnflag") == flag, F.lit(name))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_id"), F.col("l_orderkey").alias("match_id"),
        (F.col("l_extendedprice") / 1e4).alias("y"), F.col("l_quantity").cast("double").alias("weight"),
        F.array_compact(F.array(on("A", "a_off"), on("R", "r_off"))).alias("tokens"),
    )


def _ridge_at(rows, lam):
    from touchline.operators.design import Design

    fit = RG.fit_ridge(Design(rows, None, [], []), lambdas=[lam], n_folds=2)
    out = fit.table(lam).select("feature", "coefficient")
    line = out.sparkSession.createDataFrame([("(intercept)", float(fit.intercepts[0]))], "feature string, coefficient double")
    return rounded(out.unionByName(line))


def ridge_one_feature(spark, folder):
    rows = _token_rows(spark, folder)
    return _ridge_at(rows.withColumn("tokens", F.filter("tokens", lambda t: t == "a_off")), 0.05)


def ridge_two_features(spark, folder):
    return _ridge_at(_token_rows(spark, folder), 0.2)


def _part_ratings(spark, folder):
    p = table(spark, folder, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("player_id"), F.concat(F.lit("n"), F.col("p_partkey") % 1500).alias("player_name"),
        (F.col("p_size") / 7.0).alias("rating"), (F.sin("p_retailprice") * 3).alias("rapm"), (F.cos("p_retailprice") * 2).alias("spm"),
        (F.col("p_size") / 11.0 + 0.3).alias("o_rating"), (F.cos(F.col("p_partkey").cast("double"))).alias("d_rating"), F.col("p_retailprice").alias("total_minutes"), F.col("p_type").alias("position"),
        F.col("p_brand").alias("team"), (1995 + F.col("p_partkey") % 5).alias("season_end_year"),
    )


def rating_comparison(spark, folder):
    r = _part_ratings(spark, folder)
    return rounded(RT.compare_ratings(r, r, r.where(F.col("season_end_year") > 1996)).drop("player_name"))


def rating_agreement(spark, folder):
    r = _part_ratings(spark, folder)
    return rounded(RT.rating_agreement(r, r, r.where(F.col("season_end_year") > 1996)))


def predictive_power(spark, folder):
    r = _part_ratings(spark, folder)
    return rounded(RT.predictive_power(r, r))


def rating_profiles(spark, folder):
    return rounded(RT.scatter_data(_part_ratings(spark, folder)).select("player_id", "profile", "label"))


def rating_ranks(spark, folder):
    out = RT.ranked_players(_part_ratings(spark, folder), position="^econ")
    return rounded(out.select("player_id", "rank", "rating"))


def top_ratings(spark, folder):
    r = _part_ratings(spark, folder)
    top = RT.top_offensive(r, 10).select("player_id", F.lit("offense").alias("part"))
    return top.unionByName(RT.top_defensive(r, 10).select("player_id", F.lit("defense").alias("part")))


def rating_extremes(spark, folder):
    return rounded(RT.rating_report(_part_ratings(spark, folder).withColumn("rating", F.col("rapm")), top_n=10).select("player_id", "rank", "part"))


def team_roll_up(spark, folder):
    r = _part_ratings(spark, folder)
    return rounded(RT.team_ratings(r.drop("team"), r))


def final_ratings(spark, folder):
    r = _part_ratings(spark, folder)
    prior = r.select("player_id", "player_name", "total_minutes", F.col("rapm").alias("xrapm"), F.col("o_rating").alias("offense"), F.col("d_rating").alias("defense"))
    base = r.select("player_name", "total_minutes", F.col("spm").alias("rapm"), F.col("o_rating").alias("offense"), F.col("d_rating").alias("defense"))
    out = RT.final_ratings(prior, base, r)
    return rounded(out.select("player_id", "rating", "base_rapm", "spm_overall", "rating_percentile", "rating_rank"))


def rating_export(spark, folder):
    r = _part_ratings(spark, folder).select("player_id", "player_name", "total_minutes", F.col("rapm").alias("xrapm"), F.col("o_rating").alias("offense"), F.col("d_rating").alias("defense"), "season_end_year")
    return RT.export_ratings(r, _part_ratings(spark, folder))


def run_comparison(spark, folder):
    r = _part_ratings(spark, folder)
    return rounded(RT.compare_runs(r, r.withColumn("rapm", F.col("spm"))).select("player_id", "first", "second", "diff"))


def season_consistency(spark, folder):
    r = _part_ratings(spark, folder).withColumn("player_name", F.col("team"))
    return rounded(RT.season_consistency(r, "rapm", min_seasons=3))


def seasonal_against_overall(spark, folder):
    r = _part_ratings(spark, folder)
    overall = r.groupBy("player_name").agg(F.max("rapm").alias("rapm"))
    return rounded(RT.seasonal_vs_overall(r, overall, "rapm"))


def stat_agreement(spark, folder):
    r = _part_ratings(spark, folder)
    return rounded(RT.stat_agreement(r, r.withColumns({"rating": F.col("spm"), "rapm": F.col("o_rating")}), ["rating", "rapm"]))


def contribution_split(spark, folder):
    r = _part_ratings(spark, folder)
    f = r.where(F.col("season_end_year") > 1995).select("player_id", F.col("rapm").alias("xG_p90"), F.col("o_rating").alias("Sh_p90"), F.col("spm").alias("Tkl_p90"))
    out = RT.split_contributions(r.select("player_id", "rating"), f)
    return rounded(out)


def primary_teams(spark, folder):
    li = table(spark, folder, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("player_name"), F.col("l_returnflag").alias("team"))
    return RT.primary_teams(li)


def team_validation(spark, folder):
    from touchline.queries.forecasts import results

    games = results(spark, folder).withColumns({"home_team": F.col("home_team").cast("string"), "away_team": F.col("away_team").cast("string")})
    r = _part_ratings(spark, folder).withColumns({"player_name": F.col("player_id"), "offense": F.col("o_rating"), "defense": F.col("d_rating")})
    teams = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("player_name"), (F.col("p_partkey") % 90).cast("string").alias("primary_team"))
    strength = RT.team_strength(r.drop("team"), teams)
    out = RT.team_validation(games, strength)
    return rounded(out.select("team", "total_npxgd", "sum_rating", "npxgd_rank", "rating_rank", "rank_diff"), 4)


def value_ranks(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("v"))
    out = K.with_ranks(o, "v", ["o_orderstatus"], rank_min="rank_min", rank_avg_desc="rank_avg", share_at_most="share")
    return rounded(out.drop("v"))


def value_quantiles(spark, folder):
    o = table(spark, folder, "orders")
    return rounded(K.exact_quantiles(o, "o_totalprice", {"q10": 0.1, "median": 0.5, "q95": 0.95}, ["o_orderstatus"]))


def most_frequent(spark, folder):
    return K.modal_value(table(spark, folder, "lineitem"), ["l_suppkey"], "l_returnflag", "flag")


_KEY = "regexp_replace(lower(trim(raw)), '\\s+', '', 'g')"
_RAW = "(SELECT *, '  ' || upper(c_mktsegment) || '   ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN ' Jr.' ELSE '' END AS raw FROM customer)"
_CAP = lambda s: f"array_to_string(list_transform(string_split({s}, ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
_SEASON = "CASE WHEN month(d) < 8 THEN (year(d) - 1) || '-' || year(d) ELSE year(d) || '-' || (year(d) + 1) END"
_RR = f"""(SELECT '/m/' || o_orderkey AS match_url, CAST(o_orderdate AS DATE) AS d, {_C('o_custkey')} AS home_team, {_C('o_orderkey')} AS away_team, CAST(o_custkey % 4 AS DOUBLE) AS hg,
  CAST(o_orderkey % 3 AS DOUBLE) AS ag, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE round(o_totalprice / 300000, 3) END AS hx, year(o_orderdate) AS y, o_orderstatus AS league FROM orders)"""
_RL = f"""(SELECT '/m/' || l_orderkey AS match_url, 'Mr ' || l_partkey AS player_name, CASE WHEN l_partkey % 2 = 0 THEN lpad(CAST(l_partkey AS VARCHAR), 8, '0') ELSE 'mr' || l_partkey END AS player_id, {_C('l_suppkey')} AS team,
  l_linestatus = 'O' AS is_home, l_quantity AS q, l_returnflag AS rf, l_suppkey % 7 AS s7, l_suppkey % 2 AS s2, l_linenumber AS ln, l_discount AS disc, l_tax AS tax FROM lineitem)"""
_P = """(SELECT CAST(p_partkey AS VARCHAR) AS player_id, 'n' || (p_partkey % 1500) AS player_name, p_size / 7.0 AS rating, sin(p_retailprice) * 3 AS rapm, cos(p_retailprice) * 2 AS spm, p_size / 11.0 + 0.3 AS o_rating,
  cos(CAST(p_partkey AS DOUBLE)) AS d_rating, p_retailprice AS total_minutes, p_type AS position, p_brand AS team, 1995 + p_partkey % 5 AS season_end_year FROM part)"""
_HEX = lambda c: f"lpad(lower(printf('%x', {c})), 8, '0')"
_WITH = f"""WITH seg AS MATERIALIZED ({LS.SEGMENTS}), pl AS MATERIALIZED (SELECT s.segment_id, s.start_minute, s.end_minute, p.is_home, p.player_id
  FROM seg s JOIN ({LS.LINEUPS}) p ON p.match_id = s.match_id AND p.on_minute <= s.start_minute AND p.off_minute > s.start_minute)"""
_PM = "(SELECT player_id, sum(end_minute - start_minute) AS mins FROM pl GROUP BY player_id)"
_ROWS = f"""
  (SELECT segment_id || ':home' AS row_id, match_id, segment_id, true AS home, npxg_home * 90 / duration AS y, greatest(duration / 90, 0.01) AS weight, gf_home - ga_home AS gd, gf_home + ga_home AS abs_goals, avg_min, 1.0 AS is_home,
    n_players_home - n_players_away AS net_players, 22 - n_players_home - n_players_away AS abs_reds, league FROM seg
   UNION ALL SELECT segment_id || ':away', match_id, segment_id, false, npxg_away * 90 / duration, greatest(duration / 90, 0.01), ga_home - gf_home, gf_home + ga_home, avg_min, 0.0, n_players_away - n_players_home,
    22 - n_players_home - n_players_away, league FROM seg)
"""
_TOKENS = f"""
  (SELECT segment_id, count(*) FILTER (mins >= 2000) AS reg, count(DISTINCT is_home) FILTER (mins < 2000) AS rep FROM pl JOIN {_PM} USING (player_id) GROUP BY segment_id)
"""

ORACLES = {
    "player_names": f"""
      SELECT c_custkey, {_CAP("lower(regexp_replace(regexp_replace(trim(raw), '\\s+', ' ', 'g'), ' Jr\\.$', ''))")} AS display, {_KEY} AS key,
        CASE WHEN c_custkey % 2 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') END AS slug,
        {_HEX('c_custkey')} AS link_id, lower(c_mktsegment)[1] || '. ' || array_to_string(string_split(regexp_replace(trim(lower(raw)), '\\s+', ' ', 'g'), ' ')[2:], ' ') AS initial, 'Zoe e' || c_name AS plain FROM {_RAW}""",
    "team_names": f"SELECT c_custkey, {_C('c_custkey')} AS team FROM customer",
    "season_labels": f"""
      WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)
      SELECT o_orderkey, {_SEASON} || '_' || strftime(d, '%Y%m%d') || '_' || o_orderstatus || '_' || o_orderpriority AS key, {_SEASON} AS season, CAST(right({_SEASON}, 4) AS DOUBLE) AS end_year,
        CAST(right({_SEASON}, 4) AS INT) AS end_year_label, CASE WHEN month(d) >= 7 THEN year(d) + 1 ELSE year(d) END AS end_year_date, left({_SEASON}, 4) AS start_year, year(d) || '-' || (year(d) + 1) AS full_label,
        {_SEASON} AS url_season FROM o""",
    "clock_texts": """
      SELECT CAST(CAST(l_quantity AS INT) AS VARCHAR) || CASE WHEN l_suppkey % 3 = 0 THEN '+' || l_linenumber ELSE '' END AS text, l_quantity AS minute, CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber ELSE 0 END AS added,
        round(l_quantity + CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber / 10 ELSE 0 END, 6) AS decimal, count(*) AS n FROM lineitem GROUP BY ALL""",
    "safe_rates": """
      SELECT l_partkey, round(sum(coalesce(l_linenumber / nullif(l_suppkey % 4, 0), 0)), 4) AS ratio, round(sum(coalesce(l_linenumber / nullif(l_suppkey % 4, 0), -1)), 4) AS flagged,
        round(sum(coalesce(l_linenumber * 90 / nullif(l_suppkey % 4, 0), 0)), 4) AS rate FROM lineitem GROUP BY 1""",
    "league_codes": "SELECT CASE o_orderstatus WHEN 'O' THEN 'EPL' WHEN 'F' THEN 'La_Liga' ELSE 'Serie_A' END AS competition, count(*) AS n FROM orders GROUP BY 1",
    "filtered_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'",
    "season_listing": f"SELECT DISTINCT {_SEASON} AS season FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) WHERE o_orderstatus = 'F'",
    "column_union": "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment, NULL AS s_nationkey FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier",
    "unseen_matches": "SELECT o_orderkey AS match_id, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')",
    "partition_report": "SELECT l_returnflag AS league, l_linestatus AS season, count(DISTINCT l_orderkey) AS n_matches, count(*) AS n_rows FROM lineitem GROUP BY ALL",
    "ingested_keys": "SELECT DISTINCT o_orderstatus AS league, year(o_orderdate) AS season, o_orderkey AS match_id FROM orders",
    "manifest": "SELECT o_orderkey AS match_id, o_orderstatus AS league, CAST(year(o_orderdate) AS VARCHAR) AS season, strftime(o_orderdate, '%Y-%m-%d') AS scraped_at FROM orders",
    "high_water_marks": """
      SELECT league, (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = league) AS max_id FROM (SELECT DISTINCT l_linestatus AS league FROM lineitem UNION SELECT r_name FROM region)""",
    "available_tables": """
      SELECT o_orderkey AS match_id, 'metadata' || CASE WHEN bool_or(coalesce(l_returnflag = 'A', false)) THEN ',summary' ELSE '' END || CASE WHEN bool_or(coalesce(l_returnflag = 'N', false)) THEN ',shots' ELSE '' END
        || CASE WHEN bool_or(coalesce(l_linestatus = 'F', false)) THEN ',events' ELSE '' END AS tables_available FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "null_profile": """
      WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', 'quality', 'toxic']) AS "column",
        unnest([count(*) - count(doc_id), count(*) - count(text), count(*) - count(lang), count(*) - count(source), count(*) - count(n_chars), count(*) - count(quality), count(*) - count(toxic)]) AS na_count, count(*) AS n FROM d)
      SELECT "column", na_count, round(na_count / n * 100, 1) AS na_pct, na_count / n * 100 > 20 AS is_high, false AS is_missing FROM c UNION ALL SELECT 'no_such_column', NULL, NULL, NULL, true""",
    "season_coverage": """
      SELECT 'orders' AS "table", count(*) AS n_rows, min(year(o_orderdate)) AS min_season, max(year(o_orderdate)) AS max_season, count(DISTINCT year(o_orderdate)) AS n_seasons FROM orders
      UNION ALL SELECT 'lineitem', count(*), min(year(l_shipdate)), max(year(l_shipdate)), count(DISTINCT year(l_shipdate)) FROM lineitem""",
    "clean_results": f"""
      SELECT (y - 1) || '-' || y || '_' || strftime(d, '%Y%m%d') || '_' || home_team || '_' || away_team AS match_id, match_url, home_team, away_team, hg AS home_goals, ag AS away_goals, hg - ag AS goal_diff, hx AS home_xg, 1.25 AS away_xg,
        round(hx - 1.25, 6) AS xg_diff, league, y AS season_end_year FROM {_RR}""",
    "clean_lineups": f"SELECT player_name, player_id, team, is_home, count(*) FILTER (match_url IN (SELECT match_url FROM {_RR})) AS n, sum(q) AS minutes, count(*) AS starts FROM {_RL} GROUP BY ALL",
    "clean_events": f"""
      SELECT CASE WHEN rf = 'A' THEN 'goal' WHEN rf = 'R' THEN 'substitution' ELSE 'red_card' END AS event_type, team, team = home_team AS is_home, false AS is_penalty, count(*) AS n, CAST(sum(ln) AS DOUBLE) AS minutes
      FROM {_RL} JOIN {_RR} USING (match_url) WHERE rf IN ('A', 'R') OR tax > 0.06 GROUP BY ALL""",
    "clean_shots": f"""
      SELECT team, rf = 'A' AS is_goal, s7 = 0 AS is_penalty, count(*) FILTER (match_url IN (SELECT match_url FROM {_RR})) AS n, sum(q) AS minutes, CAST(sum(CASE WHEN s2 = 0 THEN 3 ELSE 0 END) AS DOUBLE) AS added, round(sum(disc), 4) AS xg FROM {_RL} GROUP BY ALL""",
    "clean_stats": f"SELECT player_name, is_home, sum(q) AS min, CAST(sum(ln % 3) AS DOUBLE) AS gls, round(sum(disc), 4) AS x_g FROM {_RL} GROUP BY ALL",
    "events_from_shots": f"SELECT match_url, s7 = 0 AS is_penalty, s7 = 1 AS is_own_goal, count(*) AS n, CAST(max(ln) AS DOUBLE) AS last FROM {_RL} WHERE rf = 'A' GROUP BY ALL",
    "lineups_from_stats": f"SELECT match_url, is_home, count(*) FILTER (q >= 45) AS starters, sum(q) AS minutes FROM {_RL} GROUP BY ALL",
    "seasons_by_url": f"SELECT y AS season_end_year, count(*) AS n FROM {_RL} LEFT JOIN {_RR} USING (match_url) GROUP BY 1",
    "match_xg_from_stats": f"""
      WITH s AS (SELECT match_url, round(sum(disc) FILTER (is_home), 6) AS h, round(sum(disc) FILTER (NOT is_home), 6) AS a FROM {_RL} GROUP BY 1 HAVING count(*) FILTER (is_home) > 0)
      SELECT match_url, (y - 1) || '-' || y AS season, h AS home_xg, h AS home_npxg, a AS away_xg, a AS away_npxg, CAST(y AS DOUBLE) AS season_end_year FROM {_RR} LEFT JOIN s USING (match_url)""",
    "substitution_slots": """
      WITH l AS (SELECT l_orderkey AS m, l_linenumber AS s, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
      c AS (SELECT *, sum(CASE WHEN s % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY s) AS slot FROM l),
      o AS (SELECT *, sum(q) OVER (PARTITION BY m, slot ORDER BY s) AS off FROM c)
      SELECT m AS match_url, s AS sheet_order, s % 3 <> 0 AS is_starter, CASE WHEN s % 3 = 0 THEN 'Sub' ELSE 'Starter' END AS player_name, off - q AS on_minute, off AS off_minute FROM o""",
    "columns_renamed": "SELECT s_name AS team, s_suppkey AS player_id, s_acctbal AS mins_played_total, regexp_matches(s_name, '(?i)SUPPLIER#0+1') AS is_first FROM supplier",
    "match_page_metadata": f"""
      SELECT l_orderkey AS page_id, {_HEX('l_orderkey')} AS source_id, '2024-08-17' AS match_date, 'Home & ' || l_returnflag AS home_team, CAST(l_linenumber AS VARCHAR) AS home_score, '2' AS away_score, {_HEX('l_suppkey')} AS home_team_id,
        'Boss ' || l_suppkey AS home_manager, count(*) AS n FROM lineitem GROUP BY ALL""",
    "match_page_events": """
      SELECT CAST(CAST(l_quantity AS INT) AS VARCHAR) AS minute, '2' AS added_time, 'goal' AS event_type, 'true' AS is_home, '0000abcd' AS player_id, 'Helper' AS secondary_player, '1' AS score_home, count(*) AS n FROM lineitem GROUP BY ALL""",
    "match_page_stats": "SELECT 'P' || l_partkey AS player, 'Home & ' || l_returnflag AS team, 'true' AS is_home, '9' AS cmp_percent, CAST(sum(l_quantity) AS BIGINT) AS minutes FROM lineitem GROUP BY ALL",
    "web_page_records": "SELECT page_id, nullif(regexp_extract(url, '[a-f0-9]{8}'), '') AS source_id, CAST(NULL AS VARCHAR) AS home_team FROM pages",
    "payload_rosters": """
      SELECT l_orderkey AS match_id, 'p' || l_partkey AS player, h AS is_home, count(*) * max(CASE WHEN h THEN 1 ELSE 2 END) AS n, 0 AS chains, max(CAST(l_discount AS VARCHAR)) AS x_g FROM lineitem, (SELECT unnest([true, false]) AS h) GROUP BY ALL""",
    "payload_shots": "SELECT l_orderkey AS match_id, true AS is_home, count(*) AS n, max(CAST(l_discount AS VARCHAR)) AS x_g FROM lineitem GROUP BY 1",
    "embedded_match_info": "SELECT o_orderkey AS match_id, o_orderpriority AS home_team, CAST(o_custkey % 5 AS INT) AS home_score, 1.5 AS away_xg, CAST(NULL AS INT) AS away_score FROM orders",
    "design_rows": f"""
      {_WITH}, f AS (SELECT min(league) AS first FROM {_ROWS})
      SELECT row_id, match_id, round(y, 6) AS y, round(weight, 6) AS weight, CAST(gd AS DOUBLE) AS gd, CAST(abs_goals AS DOUBLE) AS abs_goals, avg_min, is_home, CAST(net_players AS DOUBLE) AS net_players,
        CAST(abs_reds AS DOUBLE) AS abs_reds, coalesce(reg, 0) + coalesce(rep, 0) + CASE WHEN league <> first THEN 1 ELSE 0 END AS n_features FROM {_ROWS} r LEFT JOIN {_TOKENS} USING (segment_id), f""",
    "design_minutes": f"""
      {_WITH} SELECT CAST(player_id AS VARCHAR) AS player_id, 'Player ' || player_id AS player_name, round(mins, 6) AS total_minutes FROM {_PM} WHERE mins >= 2000
      UNION ALL SELECT 'replacement', 'Replacement Level', round(coalesce(sum(mins), 0), 6) FROM {_PM} WHERE mins < 2000""",
    "ridge_cross_products": f"""
      {_WITH}, l AS (SELECT row_id, weight, unnest(['(one)', '(y)', 'gd', 'abs_goals', 'avg_min', 'is_home', 'net_players', 'abs_reds']) AS f,
        unnest([1.0, y, CAST(gd AS DOUBLE), CAST(abs_goals AS DOUBLE), avg_min, is_home, CAST(net_players AS DOUBLE), CAST(abs_reds AS DOUBLE)]) AS v FROM {_ROWS})
      SELECT a.f AS i, b.f AS j, round(sum(a.weight * a.v * b.v) / 1000, 4) + 0.0 AS s FROM l a JOIN l b ON a.row_id = b.row_id AND a.f <= b.f WHERE a.v <> 0 AND b.v <> 0 GROUP BY ALL""",
    "ridge_one_feature": """
      WITH r AS (SELECT l_quantity AS w, l_extendedprice / 1e4 AS y, CAST(l_returnflag = 'A' AS INT) AS a FROM lineitem),
      m AS (SELECT sum(w * y) / sum(w) AS y, sum(w * a) / sum(w) AS a FROM r),
      c AS (SELECT any_value(m.y) AS my, any_value(m.a) AS ma, sum(w * (r.a - m.a) ** 2) / sum(w) AS aa, sum(w * (r.a - m.a) * (r.y - m.y)) / sum(w) AS ay, sqrt(sum(w * (r.y - m.y) ** 2) / sum(w)) AS sd FROM r, m),
      b AS (SELECT *, ay / (aa + 0.05 / sd) AS b FROM c)
      SELECT 'a_off' AS feature, round(b, 6) AS coefficient FROM b UNION ALL SELECT '(intercept)', round(my - ma * b, 6) FROM b""",
    "ridge_two_features": """
      WITH r AS (SELECT l_quantity AS w, l_extendedprice / 1e4 AS y, CAST(l_returnflag = 'A' AS INT) AS a, CAST(l_returnflag = 'R' AS INT) AS r FROM lineitem),
      m AS (SELECT sum(w * y) / sum(w) AS y, sum(w * a) / sum(w) AS a, sum(w * r) / sum(w) AS r FROM r),
      c AS (SELECT any_value(m.y) AS my, any_value(m.a) AS ma, any_value(m.r) AS mr, sum(w * (r.a - m.a) ** 2) / sum(w) AS aa, sum(w * (r.r - m.r) ** 2) / sum(w) AS rr, sum(w * (r.a - m.a) * (r.r - m.r)) / sum(w) AS ar,
        sum(w * (r.a - m.a) * (r.y - m.y)) / sum(w) AS ay, sum(w * (r.r - m.r) * (r.y - m.y)) / sum(w) AS ry, 0.2 / sqrt(sum(w * (r.y - m.y) ** 2) / sum(w)) AS p FROM r, m),
      b AS (SELECT *, (ay * (rr + p) - ry * ar) / ((aa + p) * (rr + p) - ar ** 2) AS ba, (ry * (aa + p) - ay * ar) / ((aa + p) * (rr + p) - ar ** 2) AS br FROM c)
      SELECT 'a_off' AS feature, round(ba, 6) AS coefficient FROM b UNION ALL SELECT 'r_off', round(br, 6) FROM b UNION ALL SELECT '(intercept)', round(my - ma * ba - mr * br, 6) FROM b""",
    "rating_comparison": f"""
      SELECT a.player_id, round(a.rating, 6) AS rating, round(a.rapm, 6) AS rapm, round(b.spm, 6) AS spm, round(a.rating - a.rapm, 6) AS rating_vs_rapm, round(a.rating - b.spm, 6) AS rating_vs_spm, round(a.rapm - b.spm, 6) AS rapm_vs_spm
      FROM {_P} a LEFT JOIN (SELECT * FROM {_P} WHERE season_end_year > 1996) b USING (player_id)""",
    "rating_agreement": f"""
      SELECT count(*) AS n_players, round(corr(rating, rapm), 6) AS rating_rapm_cor, round(corr(rating, spm), 6) AS rating_spm_cor, round(corr(rapm, spm), 6) AS rapm_spm_cor, round(avg(rating), 6) AS rating_mean,
        round(stddev_samp(rating), 6) AS rating_sd, round(avg(rapm), 6) AS rapm_mean, round(stddev_samp(rapm), 6) AS rapm_sd, round(avg(spm), 6) AS spm_mean, round(stddev_samp(spm), 6) AS spm_sd FROM {_P} WHERE season_end_year > 1996""",
    "predictive_power": f"SELECT count(*) AS n_matched, round(corr(rating, rapm), 6) AS correlation, round(sqrt(avg((rating - rapm) ** 2)), 6) AS rmse FROM {_P}",
    "team_validation": f"""
      WITH k AS (SELECT CAST(home_team AS VARCHAR) AS h, CAST(away_team AS VARCHAR) AS a, home_xg - away_xg AS d FROM ({RES}) WHERE home_xg IS NOT NULL AND away_xg IS NOT NULL),
      x AS (SELECT team, sum(d) AS total FROM (SELECT h AS team, d FROM k UNION ALL SELECT a, -d FROM k) GROUP BY team),
      s AS (SELECT CAST(CAST(player_id AS BIGINT) % 90 AS VARCHAR) AS team, sum(rating) AS rating FROM {_P} GROUP BY 1),
      j AS (SELECT team, total, rating FROM x JOIN s USING (team)),
      r AS (SELECT *, rank() OVER (ORDER BY total DESC) + (count(*) OVER (PARTITION BY total) - 1) / 2 AS npxgd_rank, rank() OVER (ORDER BY rating DESC) + (count(*) OVER (PARTITION BY rating) - 1) / 2 AS rating_rank FROM j)
      SELECT team, round(total, 4) AS total_npxgd, round(rating, 4) AS sum_rating, npxgd_rank, rating_rank, npxgd_rank - rating_rank AS rank_diff FROM r""",
    "rating_profiles": f"""
      SELECT player_id, CASE WHEN s > 0.7 THEN 'Offensive' WHEN s > 0.55 THEN 'Balanced-Offensive' WHEN s > 0.45 THEN 'Balanced' WHEN s > 0.3 THEN 'Balanced-Defensive' ELSE 'Defensive' END AS profile, player_name AS label
      FROM (SELECT *, o_rating / (o_rating + d_rating + 0.001) AS s FROM {_P})""",
    "rating_ranks": f"SELECT player_id, rank, round(rating, 6) AS rating FROM (SELECT *, rank() OVER (ORDER BY rating DESC) AS rank FROM {_P}) WHERE regexp_matches(position, '(?i)^econ')",
    "top_ratings": f"""
      SELECT * FROM (SELECT player_id, 'offense' AS part FROM {_P} ORDER BY o_rating DESC, player_id LIMIT 10) UNION ALL SELECT * FROM (SELECT player_id, 'defense' FROM {_P} ORDER BY d_rating DESC, player_id LIMIT 10)""",
    "rating_extremes": f"""
      WITH r AS (SELECT *, rank() OVER (ORDER BY rapm DESC) AS rank FROM {_P})
      SELECT * FROM (SELECT player_id, rank, 'top' AS part FROM r ORDER BY rapm DESC LIMIT 10) UNION ALL SELECT * FROM (SELECT player_id, rank, 'bottom' FROM r ORDER BY rapm LIMIT 10)""",
    "team_roll_up": f"SELECT team, count(*) AS n_players, round(avg(rapm), 6) AS mean_rapm, round(sum(rapm), 6) AS total_rapm, round(max(rapm), 6) AS top_player_rapm FROM {_P} GROUP BY team",
    "final_ratings": f"""
      WITH p AS {_P}, b AS (SELECT player_name, arg_max(spm, (total_minutes, player_id)) AS s FROM p GROUP BY 1)
      SELECT player_id, round(rapm, 6) AS rating, round(s, 6) AS base_rapm, round(s, 6) AS spm_overall, round(100.0 * (rank() OVER (ORDER BY rapm) + (count(*) OVER (PARTITION BY rapm) - 1) / 2) / count(*) OVER (), 6) AS rating_percentile,
        rank() OVER (ORDER BY rapm DESC) + (count(*) OVER (PARTITION BY rapm) - 1) / 2 AS rating_rank FROM p JOIN b USING (player_name)""",
    "rating_export": f"""
      SELECT rank() OVER (ORDER BY rapm DESC) AS rating_rank, player_name, round(rapm, 4) AS rating, round(o_rating, 4) AS offense, round(d_rating, 4) AS defense, round(spm, 4) AS spm_overall, total_minutes,
        round(100.0 * rank() OVER (ORDER BY rapm) / count(*) OVER (), 1) AS rating_percentile FROM {_P} WHERE season_end_year = 1999""",
    "run_comparison": f"SELECT player_id, round(rapm, 6) AS first, round(spm, 6) AS second, round(rapm - spm, 6) AS diff FROM {_P}",
    "season_consistency": f"""
      SELECT team AS player_name, count(*) AS n_seasons, string_agg(DISTINCT CAST(season_end_year AS VARCHAR), ', ' ORDER BY CAST(season_end_year AS VARCHAR)) AS seasons, round(avg(rapm), 6) AS mean_rapm, round(stddev_samp(rapm), 6) AS sd_rapm,
        round(sum(total_minutes), 6) AS total_minutes FROM {_P} GROUP BY team HAVING count(*) >= 3""",
    "seasonal_against_overall": f"""
      SELECT player_name, round(avg(rapm), 6) AS mean_seasonal, count(*) AS n_seasons, round(max(rapm), 6) AS overall, round(avg(rapm) - max(rapm), 6) + 0.0 AS diff FROM {_P} GROUP BY player_name""",
    "stat_agreement": f"SELECT 'rating' AS stat, count(*) AS n_players, round(corr(rating, spm), 6) AS correlation FROM {_P} UNION ALL SELECT 'rapm', count(*), round(corr(rapm, o_rating), 6) FROM {_P}",
    "contribution_split": f"""
      WITH f AS (SELECT * FROM {_P} WHERE season_end_year > 1995), m AS (SELECT avg(rapm) AS a1, stddev_samp(rapm) AS s1, avg(o_rating) AS a2, stddev_samp(o_rating) AS s2, avg(spm) AS a3, stddev_samp(spm) AS s3 FROM f),
      z AS (SELECT player_id, abs(((rapm - a1) / s1 + (o_rating - a2) / s2) / 2) AS o, abs((spm - a3) / s3) AS d FROM f, m)
      SELECT player_id, round(rating, 6) AS rating, round(rating * coalesce(o / (o + d), 0.5), 6) AS o_rating, round(rating * coalesce(d / (o + d), 0.5), 6) AS d_rating FROM (SELECT player_id, rating FROM {_P}) LEFT JOIN z USING (player_id)""",
    "primary_teams": """
      SELECT player_name, team AS primary_team FROM (SELECT 'p' || l_partkey AS player_name, l_returnflag AS team, rank() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY l_partkey, l_returnflag) WHERE r = 1""",
    "value_ranks": """
      WITH o AS (SELECT o_orderkey, o_orderstatus, floor(o_totalprice / 1000) AS v FROM orders)
      SELECT o_orderkey, o_orderstatus, rank() OVER (PARTITION BY o_orderstatus ORDER BY v) AS rank_min, rank() OVER (PARTITION BY o_orderstatus ORDER BY v DESC) + (count(*) OVER (PARTITION BY o_orderstatus, v) - 1) / 2 AS rank_avg,
        round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY v), 6) AS share FROM o""",
    "value_quantiles": """
      SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.1), 6) AS q10, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.95), 6) AS q95 FROM orders GROUP BY 1""",
    "most_frequent": "SELECT l_suppkey, arg_min(l_returnflag, (-n, l_returnflag)) AS flag FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1",
}
ROWS_ONLY: list[str] = []
QUERIES = {name: globals()[name] for name in [*ORACLES, *ROWS_ONLY]}
