"""Records of many match pages at once, by arrays over all their tags; equal to `pages.page_records` page by page.

Tags of a batch are found in its bytes, every distinct tag is parsed once by the HTML parser, and elements are
ranges of tag numbers. Pages that aren't plainly nested (comments, scripts, unclosed or crossing tags, stray
brackets) go through `page_records` one by one.
"""

import json
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from touchline.sources import pages as P

BYTES = 8_000_000
KEPT_TAGS = 100_000
DEEPEST = 100
IGNORED, OPEN, LEAF, END = 0, 1, 2, 3
RECORD_TABLES = ["metadata", *P.TABLE_KINDS, "keeper", "shots", "events"]
# letters and the slash of an end tag: what may follow "<" in a plain page
_NAME = np.zeros(256, bool)
_NAME[[*range(65, 91), *range(97, 123)]] = True
_HEX = re.compile("[a-f0-9]{8}")
_DAY = re.compile(r"[A-Z][a-z]+-\d{1,2}-\d{4}")
_quote = json.encoder.encode_basestring
_TEAM_TABLE = re.compile(f"stats_([a-f0-9]{{8}})_({'|'.join(P.TABLE_KINDS)})|keeper_stats_([a-f0-9]{{8}})")


class Tag:
    """A distinct tag: what it does to the open elements, its name, attributes and classes."""

    __slots__ = ("kind", "name", "attrs", "names", "team", "team_table", "marks")

    def __init__(self, kind: int, name: str, attrs=()):
        self.kind, self.name, self.attrs = kind, name, dict(attrs)
        self.names = (self.attrs.get("class") or "").split()
        self.team = P._first("stats_([a-f0-9]{8})_", self.attrs.get("id"), 1) if name == "table" else None
        own = _TEAM_TABLE.fullmatch(self.attrs.get("id") or "")
        self.team_table = own and (own[1] or own[3], own[2] or "keeper")
        self.marks = sum(1 << k for k, test in enumerate(TESTS.values()) if test(self))


# by which elements are looked up, as in a style sheet where that can say it
TESTS: dict[str, Callable[[Tag], bool]] = {
    **{name: lambda t, name=name: t.name == name for name in ("a", "div", "strong", "th", "small", "span", "thead", "tbody", "tr")},
    **{f".{c}": lambda t, c=c: c in t.names for c in ("scorebox", "scorebox_meta", "score", "datapoint", "lineup", "venuetime", "event", "event_icon")},
    **{f"#{i}": lambda t, i=i: t.attrs.get("id") == i for i in ("sb_team_0", "sb_team_1", "events_wrap")},
    "th, td": lambda t: t.name in ("th", "td"),
    "team's table": lambda t: t.team is not None,
    "statistics": lambda t: t.team_table is not None or t.attrs.get("id") == "shots_all",
}
_BIT = {test: k for k, test in enumerate(TESTS)}


class _Probe(HTMLParser):
    """What the parser reports for one tag on its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found.append(Tag(LEAF if tag in P.VOID else OPEN, tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.found.append(Tag(LEAF, tag, attrs))

    def handle_endtag(self, tag):
        self.found.append(Tag(IGNORED if tag in P.VOID else END, tag))

    def handle_data(self, data):
        self.found.append(None)


def parse_tag(inside: str) -> Tag | None:
    """The tag between two brackets; None where it depends on what follows it."""
    if inside.count('"') % 2 or inside.count("'") % 2:
        return None
    probe = _Probe()
    probe.feed(f"<{inside}>")
    return probe.found[0] if len(probe.found) == 1 and not probe.rawdata and probe.cdata_elem is None else None


_tags: dict[str, Tag | None] = {}


def _parsed(inside: list[str]) -> list[Tag | None]:
    if len(_tags) > KEPT_TAGS:
        _tags.clear()
    out = []
    for t in inside:
        if t not in _tags:
            _tags[t] = parse_tag(t)
        out.append(_tags[t])
    return out


def _slices(data, start: np.ndarray, end: np.ndarray) -> pa.LargeStringArray:
    """Texts between the given bytes, which follow each other; every second one is a gap."""
    bounds = np.empty(2 * len(start) + 1, np.int64)
    bounds[:-1:2], bounds[1::2] = start, end
    bounds[-1] = end[-1] if len(end) else 0
    return pa.LargeStringArray.from_buffers(2 * len(start), pa.py_buffer(bounds), data)


class Pages:
    """Tags of a batch of pages; an element is the number of its start tag. A page begins with a tag of its own, its root."""

    def __init__(self, html: pa.Array):
        html = html.fill_null("").cast(pa.large_string())
        data, n = html.buffers()[2], len(html)
        at = np.frombuffer(html.buffers()[1], np.int64)[html.offset : html.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        raw = raw[: at[-1]]
        low, high = at[0] + np.flatnonzero(raw[at[0] :] == 60), at[0] + np.flatnonzero(raw[at[0] :] == 62)
        of = np.searchsorted(at, low, "right") - 1
        self.odd = np.bincount(of, minlength=n) != np.bincount(np.searchsorted(at, high, "right") - 1, minlength=n)
        keep = ~self.odd[of]
        low, of = low[keep], of[keep]
        high = high[~self.odd[np.searchsorted(at, high, "right") - 1]]
        following = np.append(low[1:], at[-1])
        following = np.minimum(following, at[of + 1])
        first, second = raw[np.minimum(low + 1, max(len(raw) - 1, 0))], raw[np.minimum(low + 2, max(len(raw) - 1, 0))]
        plain = (low < high) & (high < following) & (_NAME[first] | ((first == 47) & _NAME[second]))
        self.odd[of[~plain]] = True
        keep = ~self.odd[of]
        low, high, of = low[keep], high[keep], of[keep]

        inside = _slices(data, low + 1, high).take(pa.array(np.arange(0, 2 * len(low), 2))).dictionary_encode()
        self.tags: list[Tag | None] = [*_parsed(inside.dictionary.to_pylist()), Tag(IGNORED, "")]
        code = inside.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.odd[of[np.array([t is None for t in self.tags])[code]]] = True

        # every page, odd ones with nothing else, gets its root
        keep = ~self.odd[of]
        low, high, of, code = low[keep], high[keep], of[keep], code[keep]
        self.root = np.arange(n) + np.searchsorted(of, np.arange(n))
        spot = np.arange(len(of)) + of + 1
        size = len(of) + n
        self.code, self.page = np.full(size, len(self.tags) - 1), np.empty(size, np.int64)
        text_from, text_to = np.empty(size, np.int64), np.empty(size, np.int64)
        self.code[spot], self.page[spot], text_from[spot] = code, of, high + 1
        self.page[self.root], text_from[self.root] = np.arange(n), at[:-1]
        self.last = np.append(self.root[1:], size)  # one after the page's last tag
        text_to[spot - 1] = low
        text_to[self.last - 1] = at[1:]
        # a text after the last tag may be a reference cut short
        tail = np.flatnonzero((text_to > text_from)[self.last - 1] & ~self.odd)
        self.odd[[p for p in tail if b"&" in raw[text_from[self.last[p] - 1] : at[p + 1]].tobytes()]] = True
        self._texts = _slices(data, text_from, text_to) if data is not None else pa.nulls(2 * size, pa.large_string()).fill_null("")
        self._nest()

    def _nest(self) -> None:
        """Ends and levels of elements; pages whose tags don't pair up are odd."""
        kind = np.array([0 if t is None else t.kind for t in self.tags])[self.code]
        names: dict[str, int] = {}
        name = np.array([names.setdefault("" if t is None else t.name, len(names)) for t in self.tags])[self.code]
        step = (kind == OPEN).astype(np.int64) - (kind == END)
        depth = np.cumsum(step)
        depth -= (depth[self.root] - step[self.root])[self.page]
        if len(depth):
            self.odd |= (depth[self.last - 1] != 0) | (np.minimum.reduceat(depth, self.root) < 0) | (np.maximum.reduceat(depth, self.root) > DEEPEST)
        self.level = np.where(kind == OPEN, depth, depth + 1).astype(np.int16)
        self.end = np.arange(len(kind))
        pairs = np.flatnonzero((step != 0) & ~self.odd[self.page])
        at_level = self.level[pairs]
        for k in range(1, (at_level.max() if len(pairs) else 0) + 1):
            here = pairs[at_level == k]
            self.end[here[::2]] = here[1::2]
            self.odd[self.page[here[::2][name[here[::2]] != name[here[1::2]]]]] = True
        self._started = np.flatnonzero(((kind == OPEN) | (kind == LEAF)) & ~self.odd[self.page])
        self._marks = np.array([0 if t is None else t.marks for t in self.tags], np.int64)[self.code[self._started]]
        self.end[self.root] = self.last

    def where(self, test: str) -> np.ndarray:
        """Elements whose tag passes one of `TESTS`."""
        return self._started[np.flatnonzero(self._marks & np.int64(1 << _BIT[test]))]

    def first(self, elements: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The first of `among` below each element, -1 where there is none or no element."""
        if not len(among):
            return np.full(len(elements), -1)
        at = np.searchsorted(among, elements, "right")
        found = among[np.minimum(at, len(among) - 1)]
        return np.where((elements >= 0) & (at < len(among)) & (found < self.end[elements]), found, -1)

    def every(self, elements: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All of `among` below each element, as (position in `elements`, element found)."""
        low = np.searchsorted(among, elements, "right")
        n = np.where(elements >= 0, np.searchsorted(among, self.end[elements]) - low, 0).clip(0)
        return np.repeat(np.arange(len(elements)), n), among[_ranges(low, n)]

    def texts(self, elements: np.ndarray) -> list[str]:
        """All text inside each element."""
        n = self.end[elements] - elements
        parts = self._texts.take(pa.array(2 * _ranges(elements, n)))
        marked = np.flatnonzero(pc.match_substring(parts, "&").to_numpy(zero_copy_only=False))
        out = parts.to_numpy(zero_copy_only=False).tolist()
        for i, text in zip(marked.tolist(), _each(unescape, [out[i] for i in marked.tolist()])):
            out[i] = text
        if (n == 1).all():
            return out
        ends = np.cumsum(n)
        return ["".join(out[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist())]

    def attrs(self, elements: np.ndarray, name: str) -> list[str | None]:
        tags = self.tags
        return [tags[c].attrs.get(name) for c in self.code[elements].tolist()]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for n numbers, one range after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _spread(at: np.ndarray, values: list, n: int) -> list:
    """A list of n with the values at their positions; the first one counts where there are several."""
    out = [None] * n
    for i, v in zip(reversed(at.tolist()), reversed(values)):
        out[i] = v
    return out


def _each(rule: Callable, values: list) -> list:
    """The rule's result for every value, found once per distinct value."""
    known = {v: rule(v) for v in set(values)}
    return [known[v] for v in values]


def _id(text: str | None) -> str | None:
    m = _HEX.search(text or "")
    return m and m.group()


def _json(values: list[str | None]) -> list[str]:
    return ["null" if v is None else _quote(v) for v in values]


def _dumped(names: list[str], columns: list[list[str]]) -> list[str]:
    """JSON objects of columns that are JSON already."""
    pattern = "{" + ", ".join(f'"{c}": %s' for c in names) + "}"
    return [pattern % row for row in zip(*columns)]


def _days(urls: list[str]) -> list[str | None]:
    return _each(lambda d: d and P.day_of(d), [m and m.group() for m in map(_DAY.search, urls)])


def _event_kind(classes: str | None) -> str | None:
    return next((name for pattern, name in P.EVENT_ICONS if re.search(pattern, classes or "")), None)


def _linked(g: Pages, elements: np.ndarray, links: np.ndarray) -> tuple[list, list]:
    """Text and id of the first link below each element."""
    link = g.first(elements, links)
    at = np.flatnonzero(link >= 0)
    names = _spread(at, g.texts(link[at]), len(elements))
    return names, _spread(at, _each(_id, g.attrs(link[at], "href")), len(elements))


def _second(at: np.ndarray, values: list, n: int) -> tuple[list, list]:
    """First and second value of each position, in ascending order of position."""
    start = np.searchsorted(at, np.arange(n))
    count = np.searchsorted(at, np.arange(n), "right") - start
    return tuple([values[s + k] if c > k else None for s, c in zip(start.tolist(), count.tolist())] for k in (0, 1))


def metadata(g: Pages, urls: list[str]) -> tuple[dict[str, list], dict[int, dict]]:
    """Fields of all pages as columns, and of pages with a box of details whole."""
    n, root = len(urls), g.root
    links, divs = g.where("a"), g.where("div")
    box = g.first(root, g.where(".scorebox"))
    meta = g.first(root, g.where(".scorebox_meta"))
    of, strong = g.every(box, g.where("strong"))
    inner, a = g.every(strong, links)
    home, away = _second(of[inner], g.texts(a), n)
    of, score = g.every(box, g.where(".score"))
    home_score, away_score = _second(of, _each(lambda s: P._first(r"^\s*\d+\s*$", s), g.texts(score)), n)
    tables = g.where("team's table")
    teams: list[list[str]] = [[] for _ in range(n)]
    for p, c in zip(g.page[tables].tolist(), g.code[tables].tolist()):
        if g.tags[c].team not in teams[p]:
            teams[p].append(g.tags[c].team)
    out = {
        "source_id": [*map(_id, urls)], "match_date": _days(urls), "home_team": home, "away_team": away,
        "home_score": home_score, "away_score": away_score,
        "home_team_id": [t[0] if t else None for t in teams], "away_team_id": [t[1] if len(t) > 1 else None for t in teams],
    }
    points = g.where(".datapoint")
    for side, box_id in (("home", "sb_team_0"), ("away", "sb_team_1")):
        of, point = g.every(g.first(root, g.where(f"#{box_id}")), points)
        texts = g.texts(point)
        for label in ("Manager", "Captain"):
            begins = re.compile(f"{label}:", re.I).match
            hit = _each(lambda t: bool(begins(t)), texts)
            out[f"{side}_{label.lower()}"] = _spread(of[hit], [P.after_label(label, t) for t in compress(texts, hit)], n)
        link = g.first(point, links)
        hit = np.array(hit, bool) & (link >= 0)
        out[f"{side}_captain_id"] = _spread(of[hit], [*map(_id, g.attrs(link[hit], "href"))], n)
    formations = {}
    heads, lineups = g.where("th"), g.where(".lineup")
    for side, lineup_id in (("home", "a"), ("away", "b")):
        own = lineups[[i == lineup_id for i in g.attrs(lineups, "id")]]
        head = g.first(g.first(root, own), heads)
        at = np.flatnonzero(head >= 0)
        formations[f"{side}_formation"] = _spread(at, [P.formation(t) for t in g.texts(head[at])], n)
    detailed = np.flatnonzero(meta >= 0)
    of, div = g.every(meta[detailed], divs)
    details: dict[int, dict] = {}
    starts = np.searchsorted(of, np.arange(len(detailed) + 1)).tolist()
    texts = g.texts(div)
    clock = g.first(meta[detailed], g.where(".venuetime"))
    for k, p in enumerate(detailed.tolist()):
        found = {c: v[p] for c, v in out.items()} | P.match_details(texts[starts[k] : starts[k + 1]])
        if clock[k] >= 0:
            found |= P.kickoff(g.tags[g.code[clock[k]]].attrs)
        details[p] = found | {c: v[p] for c, v in formations.items()}
    return out | formations, details


def events(g: Pages, ids: list[str | None]) -> tuple[list[int], list[str]]:
    """Pages and JSON of timeline events, sorted by page, minute and added time."""
    wrap = g.first(g.root, g.where("#events_wrap"))
    _, node = g.every(wrap, g.where(".event"))
    icon = g.first(node, g.where(".event_icon"))
    kinds = _each(_event_kind, [c if i >= 0 else None for i, c in zip(icon.tolist(), g.attrs(icon, "class"))])
    known = np.array([k is not None for k in kinds], bool)
    node, n, kinds = node[known], int(known.sum()), [*compress(kinds, known)]
    links, smalls = g.where("a"), g.where("small")
    head = g.first(node, g.where("div"))
    at = np.flatnonzero(head >= 0)
    clocks = _spread(at, _each(P.event_clock, g.texts(head[at])), n)
    span = g.first(g.first(head, smalls), g.where("span"))
    at = np.flatnonzero(span >= 0)
    scores = _spread(at, _each(P.event_score, g.texts(span[at])), n)
    of, small = g.every(node, smalls)
    hit = np.array(_each(P.names_second, g.texts(small)), bool)
    second = np.array(_spread(of[hit], small[hit].tolist(), n), object)
    second[second == None] = -1  # noqa: E711
    player, other = _linked(g, node, links), _linked(g, second.astype(np.int64), links)
    page = g.page[node].tolist()
    clocks, scores = [c or (None, None) for c in clocks], [s or (None, None) for s in scores]
    records = _dumped(
        ["source_id", "minute", "added_time", "event_type", "is_home", "player", "player_id", "secondary_player", "secondary_player_id", "score_home", "score_away"],
        [
            _json([ids[p] for p in page]), _json([c[0] for c in clocks]), _json([c[1] for c in clocks]), _json(kinds),
            _each(lambda c: "true" if "a" in g.tags[c].names else "false", g.code[node].tolist()),
            _json(player[0]), _json(player[1]), _json(other[0]), _json(other[1]), _json([s[0] for s in scores]), _json([s[1] for s in scores]),
        ],
    )
    order = sorted(range(n), key=lambda i: (page[i], *P.event_order(*clocks[i])))
    return [page[i] for i in order], [records[i] for i in order]


def stats(g: Pages, tables: np.ndarray) -> tuple[list[int], list[tuple[str, ...]], list[str]]:
    """Body rows as `pages.stats_rows` has them: the position in `tables` and the names of each row, and the cells of all."""
    rows, cells = g.where("tr"), g.where("th, td")
    of, header = g.every(g.first(tables, g.where("thead")), rows)
    start = np.searchsorted(of, np.arange(len(tables)))
    count = np.searchsorted(of, np.arange(len(tables)), "right") - start
    has = np.flatnonzero(count > 0)
    header = header[start[has] + np.minimum(1, count[has] - 1)]
    of, th = g.every(header, g.where("th"))
    texts, bounds = g.texts(th), np.searchsorted(of, np.arange(len(has) + 1)).tolist()
    names = _each(lambda header: tuple(P.header_names(header)), [tuple(texts[a:b]) for a, b in zip(bounds, bounds[1:])])
    of, row = g.every(g.first(tables[has], g.where("tbody")), rows)
    kept = ~np.array(_each(P.left_out, g.attrs(row, "class")), bool)
    of, row = of[kept], row[kept]
    inner, cell = g.every(row, cells)
    own = g.level[cell] == g.level[row[inner]] + 1
    inner, cell = inner[own], cell[own]
    n = np.diff(np.searchsorted(inner, np.arange(len(row) + 1)))
    fits = n == np.array([len(x) for x in names], np.int64)[of]
    return has[of[fits]].tolist(), [names[t] for t in of[fits].tolist()], g.texts(cell[fits[inner]])


def _tables(g: Pages, out: dict[str, list]) -> tuple[np.ndarray, list[tuple[int, int, bool | None]]]:
    """Statistics tables, each with (page, rank among the page's records, is home), first ones of their id only."""
    found: dict[tuple[int, int], tuple[int, bool | None]] = {}
    owned = g.where("statistics")
    home, away = out["home_team_id"], out["away_team_id"]
    for i, p, c in zip(owned.tolist(), g.page[owned].tolist(), g.code[owned].tolist()):
        if g.tags[c].team_table is None:
            found.setdefault((p, 2 * len(RECORD_TABLES)), (i, None))
            continue
        team, kind = g.tags[c].team_table
        for side, is_home in ((home, True), (away, False)):
            if side[p] == team:
                found.setdefault((p, RECORD_TABLES.index(kind) + (0 if is_home else len(RECORD_TABLES))), (i, is_home))
    return np.array([i for i, _ in found.values()], np.int64), [(*k, h) for k, (_, h) in found.items()]


def _stats_records(g: Pages, out: dict[str, list]) -> tuple[list[int], list[int], list[str], list[str]]:
    """Pages, ranks, tables and JSON of all statistics rows."""
    tables, about = _tables(g, out)
    at, names, cells = stats(g, tables)
    teams = {True: out["home_team"], False: out["away_team"]}
    # names are letters, digits and underscores
    pattern = {c: "{" + ", ".join([f'"{x}": %s' for x in c]) for c in set(names)}
    plain = {c for c in pattern if len({*c, "team", "is_home"}) == len(c) + 2}
    last = {True: '"team": %s, "is_home": true}', False: '"team": %s, "is_home": false}'}
    values, spot, record = [_quote(v) for v in cells], 0, []
    for k, c in zip(at, names):
        p, _, is_home = about[k]
        end = spot + len(c)
        if c not in plain:
            tag = {} if is_home is None else {"team": teams[is_home][p], "is_home": is_home}
            record.append(json.dumps({**dict(zip(c, cells[spot:end])), **tag}, ensure_ascii=False))
        elif is_home is None:
            record.append((pattern[c] + "}") % tuple(values[spot:end]))
        else:
            team = teams[is_home][p]
            record.append((pattern[c] + (", " if c else "") + last[is_home]) % (*values[spot:end], "null" if team is None else _quote(team)))
        spot = end
    rank = [about[k][1] for k in at]
    return [about[k][0] for k in at], rank, ["shots" if r == 2 * len(RECORD_TABLES) else RECORD_TABLES[r % len(RECORD_TABLES)] for r in rank], record


def batch_records(urls: list[str], html: pa.Array) -> tuple[np.ndarray, list[str], list[int], list[str]]:
    """All records of a batch: page, table, position in the page and JSON, by page and position."""
    g = Pages(html)
    out, details = metadata(g, urls)
    plain = np.flatnonzero(~g.odd).tolist()
    names = list(out)
    columns = [["null"] * len(plain) if not any(v) and all(x is None for x in v) else _json([v[p] for p in plain]) for v in out.values()]
    first = _dumped(names, columns)
    if details:
        first = [json.dumps(details[p], ensure_ascii=False) if p in details else r for p, r in zip(plain, first)]
    last = 3 * len(RECORD_TABLES)
    page, rank, table, record = _stats_records(g, out)
    event_page, event_record = events(g, out["source_id"])
    odd = [(p, *r) for p in np.flatnonzero(g.odd).tolist() for r in P.page_records(html[p].as_py(), urls[p])]
    page = [*plain, *page, *event_page, *(p for p, _, _ in odd)]
    rank = [*[-1] * len(plain), *rank, *[last] * len(event_page), *[0] * len(odd)]
    table = [*["metadata"] * len(plain), *table, *["events"] * len(event_page), *(t for _, t, _ in odd)]
    record = [*first, *record, *event_record, *(json.dumps(r, ensure_ascii=False) for _, _, r in odd)]
    page = np.array(page, np.int64)
    order = np.lexsort((np.array(rank, np.int64), page))
    page = page[order]
    position = np.arange(len(page)) - np.searchsorted(page, page)
    at = order.tolist()
    return page, [table[i] for i in at], position.tolist(), [record[i] for i in at]


def pieces(html: pa.Array, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of pages that follow each other, with about so many bytes."""
    ends = np.cumsum(pc.binary_length(html).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(html):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, min(stop, len(html)) - start
        start = stop
