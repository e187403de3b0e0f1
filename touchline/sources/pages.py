"""Raw match pages to tables: metadata, timeline events and player statistics.

Pages are parsed where they lie: each task turns its own batch of pages into JSON records,
and Spark spreads those into tables. Plainly nested pages go through arrays over all tags of a
batch (`page_arrays.py`), others through the tree here, one by one.
"""

import json
import re
from datetime import datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.sources.payloads import snake_case

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Icon class patterns by event type, in order, and table kinds of a page.
EVENT_ICONS = [
    (r"penalty_goal", "penalty_goal"), (r"own_goal", "own_goal"), (r"\bgoal\b", "goal"),
    (r"yellow_red_card", "yellow_red_card"), (r"red_card", "red_card"), (r"yellow_card", "yellow_card"),
    (r"substitute_in", "sub_on"),
]
TABLE_KINDS = ["summary", "passing", "passing_types", "defense", "possession", "misc"]
OFFICIALS = {"Referee": "referee", "AR1": "ar1", "AR2": "ar2", "4th": "fourth_official", "VAR": "var_official"}


class Node:
    """An element with its text parts; `order` lists all elements below it in document order."""

    __slots__ = ("tag", "attrs", "children", "texts", "names", "order")

    def __init__(self, tag="", attrs=()):
        self.tag, self.attrs, self.children, self.texts, self.order = tag, dict(attrs), [], [], None
        self.names = (self.attrs.get("class") or "").split()

    def text(self) -> str:
        return "".join(t if isinstance(t, str) else t.text() for t in self.texts)

    def walk(self) -> list["Node"]:
        if self.order is None:
            self.order = []
            for c in self.children:
                self.order.append(c)
                self.order += c.walk()
        return self.order

    def all(self, tag=None, cls=None, id=None) -> list["Node"]:
        return [
            n for n in self.walk()
            if (tag is None or n.tag == tag) and (cls is None or cls in n.names) and (id is None or n.attrs.get("id") == id)
        ]

    def one(self, tag=None, cls=None, id=None) -> "Node | None":
        for n in self.walk():
            if (tag is None or n.tag == tag) and (cls is None or cls in n.names) and (id is None or n.attrs.get("id") == id):
                return n
        return None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node()
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        self.stack[-1].texts.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        self.stack[-1].texts.append(data)


def parse_html(html: str) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    return tree.root


def _first(pattern: str, text: str | None, group: int = 0) -> str | None:
    m = re.search(pattern, text or "")
    return m.group(group) if m else None


def after_label(label: str, text: str) -> str:
    return re.sub(f"^{label}:\\s*", "", text, flags=re.I).strip()


def _datapoint(team: Node | None, label: str) -> str | None:
    for dp in team.all(cls="datapoint") if team else []:
        text = dp.text()
        if re.match(label + ":", text, re.I):
            return after_label(label, text)
    return None


def _captain_id(team: Node | None) -> str | None:
    for dp in team.all(cls="datapoint") if team else []:
        link = dp.one(tag="a")
        if re.match("Captain:", dp.text(), re.I) and link is not None:
            return _first("[a-f0-9]{8}", link.attrs.get("href"))
    return None


def day_of(text: str) -> str | None:
    """August-17-2024 as an ISO date."""
    try:
        return datetime.strptime(text, "%B-%d-%Y").date().isoformat()
    except ValueError:
        return None


def match_details(texts: list[str]) -> dict:
    """Venue, attendance and officials out of the texts of a page's box of details."""
    out = {}
    for text in texts:
        if re.search("Venue:", text, re.I):
            out["venue"] = re.sub(r".*Venue:\s*", "", text, flags=re.I | re.S).strip()
        if re.search("Attendance:", text, re.I):
            out["attendance"] = (_first("[0-9][0-9,]*", text) or "").replace(",", "") or None
        if re.search("Officials:", text, re.I):
            for official in re.split(r"\s*[·,]\s*", re.sub(r".*Officials:\s*", "", text, flags=re.I | re.S)):
                role = _first(r"\(([^)]*)\)", official, 1)
                if role in OFFICIALS:
                    out[OFFICIALS[role]] = re.sub(r"\s*\(.*", "", official).strip()
    return out


def kickoff(attrs: dict) -> dict:
    return {"kickoff_time": attrs.get("data-venue-time"), "kickoff_epoch": attrs.get("data-venue-epoch")}


def formation(header: str) -> str | None:
    return _first(r"\(([0-9]+-[0-9]+-[0-9]+(-[0-9]+)?)\)", header, 1)


def page_metadata(page: Node, url: str) -> dict:
    """Teams, score, officials, venue and formations of a match page."""
    box, meta = page.one(cls="scorebox"), page.one(cls="scorebox_meta")
    teams = [a.text() for s in box.all(tag="strong") for a in s.all(tag="a")] if box else []
    scores = [_first(r"^\s*\d+\s*$", s.text()) for s in box.all(cls="score")] if box else []
    ids = [_first("stats_([a-f0-9]{8})_", t.attrs.get("id"), 1) for t in page.all(tag="table")]
    ids = list(dict.fromkeys(i for i in ids if i))
    day = _first(r"[A-Z][a-z]+-\d{1,2}-\d{4}", url)
    day = day_of(day) if day else None
    at = lambda values, i: values[i] if len(values) > i else None
    out = {
        "source_id": _first("[a-f0-9]{8}", url), "match_date": day,
        "home_team": at(teams, 0), "away_team": at(teams, 1), "home_score": at(scores, 0), "away_score": at(scores, 1),
        "home_team_id": at(ids, 0), "away_team_id": at(ids, 1),
    }
    for side, box_id in (("home", "sb_team_0"), ("away", "sb_team_1")):
        team = page.one(id=box_id)
        out |= {
            f"{side}_manager": _datapoint(team, "Manager"), f"{side}_captain": _datapoint(team, "Captain"),
            f"{side}_captain_id": _captain_id(team),
        }
    out |= match_details([d.text() for d in meta.all(tag="div")] if meta else [])
    clock = meta.one(cls="venuetime") if meta else None
    if clock is not None:
        out |= kickoff(clock.attrs)
    for side, lineup_id in (("home", "a"), ("away", "b")):
        lineup = next((n for n in page.all(cls="lineup") if n.attrs.get("id") == lineup_id), None)
        header = lineup.one(tag="th") if lineup else None
        out[f"{side}_formation"] = formation(header.text()) if header else None
    return out


def _linked(node: Node | None) -> tuple[str | None, str | None]:
    link = node.one(tag="a") if node is not None else None
    return (link.text(), _first("[a-f0-9]{8}", link.attrs.get("href"))) if link is not None else (None, None)


def event_clock(text: str) -> tuple[str, str | None] | None:
    """Minute and added time."""
    clock = re.search(r"([0-9]+)(?:\+([0-9]+))?\+?(?:&rsquor;|['’])", text)
    return (clock.group(1), clock.group(2)) if clock else None


def event_score(text: str) -> list[str | None]:
    score = [_first(r"^\s*(\d+)\s*$", p, 1) for p in re.split("[:-]", text)]
    return score if len(score) == 2 else [None, None]


def names_second(text: str) -> bool:
    """Whether a small print of an event names a second player."""
    return bool(re.search(r"Assist:|^\s*for\s+", text, re.I))


def event_order(minute: str | None, added: str | None) -> tuple[int, int]:
    return int(minute or 10**6), int(added or 0)


def page_events(page: Node, url: str) -> list[dict]:
    """Timeline events sorted by minute and added time; events without a known icon are left out."""
    wrap, rows = page.one(id="events_wrap"), []
    for node in wrap.all(cls="event") if wrap else []:
        icon = node.one(cls="event_icon")
        classes = (icon.attrs.get("class") or "") if icon is not None else ""
        kind = next((name for pattern, name in EVENT_ICONS if re.search(pattern, classes)), None)
        if kind is None:
            continue
        head = node.one(tag="div")
        minute, added = event_clock(head.text() if head else "") or (None, None)
        small = head.one(tag="small") if head else None
        span = small.one(tag="span") if small else None
        score = event_score(span.text()) if span else [None, None]
        player, player_id = _linked(node)
        second = next(
            (s for s in node.all(tag="small") if names_second(s.text())), None
        )
        other, other_id = _linked(second)
        rows.append({
            "source_id": _first("[a-f0-9]{8}", url), "minute": minute, "added_time": added, "event_type": kind, "is_home": "a" in node.names,
            "player": player, "player_id": player_id, "secondary_player": other, "secondary_player_id": other_id,
            "score_home": score[0], "score_away": score[1],
        })
    return sorted(rows, key=lambda r: event_order(r["minute"], r["added_time"]))


def header_names(texts) -> list[str]:
    """Snake-case names of header cells; repeated ones are numbered."""
    names, seen = [], {}
    for text in texts:
        name = snake_case(text.replace("%", "_percent").replace("#", "number")) or "x"
        name = f"x{name}" if name[0].isdigit() else name
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return names


def left_out(classes: str | None) -> bool:
    """Whether a body row is a header, a spacer or part of another table."""
    return bool(re.search("thead|spacer|partial_table", classes or ""))


def stats_rows(table: Node | None) -> list[dict]:
    """Body rows of a statistics table by snake-case header; header, spacer and short rows are left out."""
    if table is None:
        return []
    head = table.one(tag="thead")
    headers = head.all(tag="tr") if head else []
    if not headers:
        return []
    names = header_names(th.text() for th in headers[min(1, len(headers) - 1)].all(tag="th"))
    body, rows = table.one(tag="tbody"), []
    for tr in body.all(tag="tr") if body else []:
        if left_out(tr.attrs.get("class")):
            continue
        cells = [c.text() for c in tr.children if c.tag in ("th", "td")]
        if len(cells) == len(names):
            rows.append(dict(zip(names, cells)))
    return rows


def page_records(html: str, url: str) -> list[tuple[str, dict]]:
    """All records of a page as (table, fields)."""
    page = parse_html(html)
    meta = page_metadata(page, url)
    records = [("metadata", meta)]
    for side in ("home", "away"):
        team_id, tag = meta.get(f"{side}_team_id"), {"team": meta.get(f"{side}_team"), "is_home": side == "home"}
        if team_id is None:
            continue
        for kind in TABLE_KINDS:
            records += [(kind, {**r, **tag}) for r in stats_rows(page.one(id=f"stats_{team_id}_{kind}"))]
        records += [("keeper", {**r, **tag}) for r in stats_rows(page.one(id=f"keeper_stats_{team_id}"))]
    records += [("shots", r) for r in stats_rows(page.one(id="shots_all"))]
    records += [("events", r) for r in page_events(page, url)]
    return records


def timeline_events(page: Node) -> list[dict]:
    """Goals, cards and substitutions of a source B timeline."""
    def player(node):
        link = node.one(cls="timeline-player-name") if node is not None else None
        href = link.attrs.get("href") if link is not None else None
        return (link.text().strip() if link is not None else None, re.sub(".*/player/", "", href) if href else None)

    rows = []
    for item in page.all(cls="timeline-item"):
        time, body = item.one(cls="timeline-time"), item.one(cls="timeline-content")
        span = time.one(tag="span") if time is not None else None
        base = {
            "minute": span.text().strip().replace("'", "") if span is not None else None,
            "team_side": "away" if "timeline-item-right" in (item.attrs.get("class") or "") else "home",
            "player": None, "player_id": None, "player_off": None, "player_off_id": None, "card_type": None, "score": None,
        }
        if body is None:
            continue
        name, pid = player(body)
        card = next((c for c in ("yellow", "red") if body.one(cls=f"{c}-card") is not None), None)
        if body.one(cls="fa-futbol") is not None:
            score = body.one(cls="timeline-match-score")
            rows.append({**base, "event_type": "goal", "player": name, "player_id": pid, "score": score.text().strip() if score else None})
        elif card is not None:
            rows.append({**base, "event_type": "card", "player": name, "player_id": pid, "card_type": card})
        elif body.one(cls="fa-long-arrow-alt-down") is not None:
            for row in body.all(cls="timeline-row"):
                titled = lambda t: next((n for n in row.walk() if n.attrs.get("title") == t), None)
                off, on = player(titled("Substituted off") or row), player(titled("Substituted on"))
                rows.append({**base, "event_type": "substitution", "player": on[0], "player_id": on[1], "player_off": off[0], "player_off_id": off[1]})
    return rows


def extract_pages(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    timeline: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """(key, url, table, position, record): every record of every page, its fields as JSON.

    `partitions` spreads pages over that many tasks first, for tables of few large files.
    """
    kind = dict(pages.dtypes)[key]
    if partitions is not None:
        pages = pages.repartition(partitions, key, url)

    def timelines(urls, batch):
        for p, h in enumerate(batch.to_pylist()):
            for i, r in enumerate(timeline_events(parse_html(h))):
                yield p, "timeline", i, json.dumps(r, ensure_ascii=False)

    def run(batches):
        from touchline.sources.page_arrays import batch_records, pieces

        for batch in batches:
            for start, n in pieces(batch[html]):
                part = batch.slice(start, n)
                urls = [u or "" for u in part[url].to_pylist()]
                found = zip(*timelines(urls, part[html])) if timeline else batch_records(urls, part[html])
                page, table, position, record = [*found] or ([], [], [], [])
                at = pa.array(page, pa.int64())
                columns = [part[key].take(at), part[url].take(at), pa.array(table, pa.string()), pa.array(position, pa.int32()), pa.array(record, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, url, "table", "position", "record"])

    schema = f"{key} {kind}, {url} string, table string, position int, record string"
    return pages.select(key, url, html).mapInArrow(run, schema)


def page_table(records: DataFrame, table: str, fields: list[str]) -> DataFrame:
    """One table out of the records, with the chosen fields as text columns."""
    rows = records.where(F.col("table") == table)
    keys = [c for c in records.columns if c not in ("table", "record")]
    parsed = rows.withColumn("_r", F.from_json("record", "map<string,string>"))
    return parsed.select(*keys, *[F.try_element_at("_r", F.lit(f)).alias(f) for f in fields])


def page_audit(records: DataFrame) -> DataFrame:
    """Records per table and page count."""
    return records.groupBy("table").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("url").alias("n_pages"))
