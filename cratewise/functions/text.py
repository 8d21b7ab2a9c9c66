"""Text functions as SQL expressions, for Spark and for the engine that checks the results.

Each function takes SQL text of a value and gives SQL text, so one definition serves ``F.expr`` in any
DataFrame and the check's queries. Null and blank values count as missing.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from cratewise.functions import rules

SPACE = r"[\s\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


class Text:
    """Builds expressions; ``spark`` chooses the dialect, ``lists`` the rule lists (those of ``rules``, if none are given)."""

    def __init__(self, spark: bool = True, lists: object = rules):
        self.spark, self.rules, self._names = spark, lists, count()

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'" if not self.spark or "\\" not in text else f"r'{text}'"

    def pattern(self, p: str) -> str:
        return self.lit(p.replace("(?i)", "(?iu)") if self.spark else p)

    def sub(self, x: str, p: str, new: str = "") -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.lit(new)}{'' if self.spark else ', ' + self.lit('g')})"

    def has(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.pattern(p)})" if self.spark else f"regexp_matches({x}, {self.pattern(p)})"

    def all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, 0)"

    def first(self, x: str, p: str, group: int) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.pattern(p)}, -1)" if self.spark else f"regexp_split_to_array({x}, {self.pattern(p)})"

    def _lambda(self, name: str, values: str, body: Callable[[str], str]) -> str:
        v = f"v{next(self._names)}"
        return f"{name}({values}, {v} -> {body(v)})" if self.spark else f"list_{name}({values}, lambda {v}: {body(v)})"

    def map(self, values: str, body: Callable[[str], str]) -> str:
        return self._lambda("transform", values, body)

    def keep(self, values: str, body: Callable[[str], str]) -> str:
        return self._lambda("filter", values, body)

    def let(self, x: str, body: Callable[[str], str]) -> str:
        """The body with the value computed once."""
        return f"{self.map(f'array({x})', body)}[0]" if self.spark else f"{self.map(f'[{x}]', body)}[1]"

    def join(self, values: str, by: str) -> str:
        return f"{'array_join' if self.spark else 'array_to_string'}({values}, {by})"

    def concat_lists(self, *values: str) -> str:
        return f"concat({', '.join(values)})" if self.spark else f"list_concat({', '.join(values)})"

    def distinct(self, values: str) -> str:
        return f"{'array_distinct' if self.spark else 'list_distinct'}({values})"

    def size(self, values: str) -> str:
        return f"{'size' if self.spark else 'len'}({values})"

    def either(self, cases: list[tuple[str, str]], other: str) -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {other} END"

    def contains_any(self, x: str, words: list[str]) -> str:
        return "(" + " OR ".join(f"contains({x}, {self.lit(w)})" for w in words) + ")"

    def lookup(self, x: str, table: dict[str, str], other: str) -> str:
        return self.either([(f"{x} = {self.lit(k)}", self.lit(v)) for k, v in table.items()], other)

    def strip(self, x: str, chars: str) -> str:
        return self.sub(x, f"^{chars}+|{chars}+$")

    def blank(self, x: str) -> str:
        return f"(coalesce({self.strip(x, SPACE)}, '') = '')"

    def clean(self, x: str) -> str:
        """Without sites and promotion, with one kind of separator; kept remarks go to the end in brackets."""
        t = f"coalesce({x}, '')"
        for p in [*self.rules.SITE_PATTERNS, *self.rules.PROMO_PATTERNS]:
            t = self.sub(t, p)
        t = self.sub(self.strip(self.sub(t, rf"{SPACE}*[-_,]+{SPACE}*", " - "), r"[-\s\p{Z},]"), SPACE + "{2,}", " ")

        def remarks(v: str) -> str:
            bare = self.sub(self.sub(v, r"\[.*?\]"), r"\(.*?\)")
            found = self.concat_lists(*(self.all(v, p) for p in self.rules.KEPT_PATTERNS))
            return self.let(found, lambda k: f"CASE WHEN {self.size(k)} > 0 THEN {bare} || ' (' || {self.join(k, self.lit(', '))} || ')' ELSE {bare} END")

        t = self.sub(self.let(t, remarks), rf"{SPACE}*[-_]+{SPACE}*", " - ")
        return self.strip(self.sub(self.strip(t, r"[-\s\p{Z}]"), SPACE + "{2,}", " "), SPACE)

    def sanitize(self, x: str) -> str:
        return f"nullif({self.clean(x)}, '')"

    def strict(self, x: str) -> str:
        """The profile that removes addresses and sites with their brackets and endings, then junk altogether."""
        sites, words, last, junk_sites = ("|".join([*self.rules.STRICT_SITES, *more]) for more in ([], self.rules.STRICT_WORDS, self.rules.STRICT_ENDS, self.rules.STRICT_JUNK))
        ends = "|".join(self.rules.DOMAINS)
        t = f"coalesce({x}, '')"
        for p in [
            rf"(?i)(?:https?://)?(?:www\.)?[a-z0-9-]+\.(?:{ends})(?:/\S*)?", rf"(?i)\b(?:{words})\b", r"(?i)hearthis\.at",
            r"\[.*?\.(?:com|in|net|org|dev).*?\]", r"\(.*?\.(?:com|in|net|org|dev).*?\)", rf"\[.*?(?:{sites}).*?\]", rf"\(.*?(?:{sites}).*?\)",
            rf"(?i)\s*-\s*(?:{last})(?:\.(?:com|dev|in|net|org))?\s*$",
        ]:
            t = self.sub(t, p)
        t = self.sub(self.sub(self.sub(t, rf"{SPACE}*[-–—]{SPACE}*", " - "), rf"{SPACE}*[,&]{SPACE}*", ", "), SPACE + "+", " ")
        runs = self.all(t, f"{WORD}+|[^" + WORD[1:] + "+")
        bare = ", ".join(map(self.lit, self.rules.DOMAINS))
        t = self.strip(self.join(self.map(runs, lambda v: f"CASE WHEN lower({v}) IN ({bare}) THEN '' ELSE {v} END"), "''"), r"[ \-,&.]")
        junk = rf"(?i)^(?:\.+|\.?(?:{ends})|[.\-,&\s]+|(?:{junk_sites})(?:\.(?:com|dev|in|net|org|so))?)$"
        return self.let(t, lambda v: f"CASE WHEN {v} = '' OR {self.has(v, junk)} THEN NULL ELSE {v} END")

    def people(self, x: str) -> str:
        """A list of people: parts cleaned, empty ones dropped. Blank stays as it is; nothing left gives null."""
        parts = self.keep(self.map(self.split(x, rf"{SPACE}*[-–—&,]{SPACE}*"), self.clean), lambda v: f"{v} <> ''")
        return f"CASE WHEN {x} IS NULL OR {x} = '' THEN {x} ELSE nullif({self.join(parts, self.lit(', '))}, '') END"

    def year(self, x: str) -> str:
        return f"nullif({self.first(x, r'(^|[^\p{L}\p{N}_])(19\d{2}|20[0-3]\d)([^\p{L}\p{N}_]|$)', 2)}, '')"

    def year_of_date(self, x: str) -> str:
        digits = self.first(x, r"(\d{4})", 1)
        return f"CASE WHEN try_cast({digits} AS INT) BETWEEN 1900 AND 2030 THEN {digits} END"

    def polluted(self, x: str) -> str:
        sites = " OR ".join(self.has(x, p) for p in self.rules.SITE_PATTERNS)
        return f"coalesce({sites} OR {self.contains_any(f'lower({x})', self.rules.POLLUTED)}, false)"

    def download_sites(self, x: str) -> str:
        """All matches, pattern by pattern."""
        letters = lambda p: p.replace(r"[\w]", WORD).replace(r"\w", WORD)
        return self.concat_lists(*(self.all(f"coalesce({x}, '')", letters(p)) for p in self.rules.DOWNLOAD_PATTERNS))

    def stem(self, path: str) -> str:
        """A file's name without folder and ending."""
        return self.sub(self.sub(path, r"^.*/"), r"\.[^.]*$")

    def name_parts(self, path: str) -> tuple[str, str]:
        """Artist and title by a file's name: parted at the first dash between spaces, else all of it is the title."""
        name = self.clean(self.stem(path))
        artist = self.let(name, lambda v: f"CASE WHEN contains({v}, ' - ') THEN {self.strip(f'split_part({v}, {self.lit(' - ')}, 1)', SPACE)} ELSE '' END")
        title = self.let(name, lambda v: f"CASE WHEN contains({v}, ' - ') THEN {self.strip(f'substr({v}, length(split_part({v}, {self.lit(' - ')}, 1)) + 4)', SPACE)} ELSE {self.strip(v, SPACE)} END")
        return artist, title

    def or_name_part(self, artist: str, title: str, path: str) -> tuple[str, str]:
        """Artist and title; where both are blank, those of the file's name."""
        none = f"({self.blank(artist)} AND {self.blank(title)})"
        return tuple(f"CASE WHEN {none} THEN {part} ELSE coalesce({own}, '') END" for own, part in zip((artist, title), self.name_parts(path), strict=True))

    def match_key(self, x: str) -> str:
        t = f"lower(coalesce({x}, ''))"
        for p in [*self.rules.MIX_LABELS, rf"feat\. (?:{WORD}|{SPACE})+", rf"ft\. (?:{WORD}|{SPACE})+"]:
            t = self.sub(t, p)
        return self.strip(self.sub(self.sub(t, r"[^\p{L}\p{N}_\s\p{Z}]"), SPACE + "+", " "), SPACE)

    def search_title(self, title: str, path: str) -> str:
        """What a track is searched by: its cleaned title, or the cleaned name of its file where that has under three characters."""
        return self.let(self.clean(title), lambda v: f"CASE WHEN length({v}) < 3 THEN {self.clean(self.stem(path))} ELSE {v} END")

    def lead(self, artist: str) -> str:
        """The comparison key of the first person of a list; empty without one."""
        return self.match_key(f"split_part({self.people(artist)}, ', ', 1)")

    def search_words(self, key: str, lead: str) -> str:
        """What a search compares: the words of a title's key (the key itself, if all are ignored) and those of the artist's, told apart."""
        title = self.let(self.tokens(key), lambda v: f"CASE WHEN {self.size(v)} = 0 THEN {'array' if self.spark else ''}{f'({key})' if self.spark else f'[{key}]'} ELSE {v} END")
        return self.concat_lists(self.map(title, lambda v: f"'t:' || {v}"), self.map(self.tokens(lead), lambda v: f"'a:' || {v}"))

    def annotate(self, comment: str, marker: str, line: str) -> str:
        """The comment with a line appended, unless its marker stands there or there is no line."""
        end = "chr(10)"
        return self.let(comment, lambda v: f"CASE WHEN {line} IS NULL OR contains(coalesce({v}, ''), {marker}) THEN {v} ELSE concat_ws({end}, nullif({v}, ''), {line}) END")

    def consolidated(self, comment: str) -> str:
        """The lines of a comment worth keeping, each once; null without any, or where the text is a player's own."""
        lines = self.join(self.distinct(self.comment_lines(comment)) if self.spark else self.comment_lines(comment), "chr(10)")
        return f"CASE WHEN contains(lower({comment}), 'itunes') THEN NULL ELSE nullif({lines}, '') END"

    def camelot(self, key: str) -> str:
        return self.lookup(key, self.rules.CAMELOT, "'Unknown'")

    def likes(self, a: str, b: str, share: float) -> str:
        """Whether two texts share so many of their tokens, both having some."""
        both = f"len(list_intersect({{x}}, {{y}})) / greatest(len({{x}}), len({{y}}), 1)" if not self.spark else "size(array_intersect({x}, {y})) / greatest(size({x}), size({y}), 1)"
        return self.let(self.tokens(a), lambda x: self.let(self.tokens(b), lambda y: f"({self.size(x)} > 0 AND {self.size(y)} > 0 AND {both.format(x=x, y=y)} >= {share})"))

    def gate(self, artist: str, title: str, year: str, new_artist: str, new_title: str, new_year: str) -> str:
        """Whether two of three signals hold: like titles, like artists, years within two (or none known)."""
        y, oy = (f"cast({self.year(x)} AS INT)" for x in (year, new_year))
        near = f"coalesce({oy} IS NOT NULL AND ({y} IS NULL OR abs({y} - {oy}) <= 2), false)"
        return f"(cast({self.likes(title, new_title, 0.7)} AS INT) + cast({self.likes(artist, new_artist, 0.5)} AS INT) + cast({near} AS INT) >= 2)"

    def tokens(self, x: str) -> str:
        stop = ", ".join(map(self.lit, ["", *self.rules.STOP_WORDS]))
        return self.distinct(self.keep(self.split(self.sub(f"lower(coalesce({x}, ''))", r"[^\p{L}\p{N}_\s\p{Z}]", " "), SPACE + "+"), lambda v: f"{v} NOT IN ({stop})"))

    def file_name(self, artist: str, title: str, year: str) -> str:
        name = self.either([
            (f"{artist} <> '' AND {title} <> '' AND {year} <> ''", f"{artist} || ' - ' || {title} || ' (' || {year} || ')'"),
            (f"{artist} <> '' AND {title} <> ''", f"{artist} || ' - ' || {title}"), (f"{title} <> ''", title), (f"{artist} <> ''", artist)], "NULL")
        plain = self.sub(self.strip(self.sub(self.sub(name, r'[<>:"/\\|?*]'), SPACE + "+", " "), SPACE), r"\.+$")
        return f"coalesce(left({plain}, 120), 'Unknown Track.mp3')"

    def title_case(self, x: str) -> str:
        parts = self.all(f"lower({x})", r"\p{L}+|[^\p{L}]+")
        return self.join(self.map(parts, lambda v: f"upper(left({v}, 1)) || substr({v}, 2)"), "''")

    def genre_of_path(self, path: str, genre: str) -> str:
        cases = [(self.contains_any(f"lower({path})", words), self.lit(name)) for name, words in self.rules.GENRE_PATHS]
        return self.either(cases, self.let(self.clean(genre), lambda v: f"CASE WHEN {v} = '' THEN 'Indian' ELSE {self.title_case(v)} END"))

    def genre_of_text(self, artist: str, title: str, album: str) -> str:
        text = f"lower(coalesce({artist}, '') || ' ' || coalesce({title}, '') || ' ' || coalesce({album}, ''))"
        return self.let(text, lambda v: self.either([(self.contains_any(v, words), self.lit(name)) for name, words in self.rules.GENRE_WORDS], "'Indian'"))

    def number(self, x: str) -> str:
        """Whether a text is a plain number."""
        return f"coalesce({self.has(f'trim({x})', r'^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$')}, false)"

    def comment_lines(self, x: str) -> str:
        """Lines of a comment that are worth keeping, cleaned."""
        lines = self.keep(self.map(self.split(f"coalesce({x}, '')", r"\r?\n"), lambda v: f"trim({v})"), lambda v: f"{v} <> '' AND {self.contains_any(f'lower({v})', self.rules.COMMENT_KEYWORDS)}")
        return self.keep(self.map(lines, self.clean), lambda v: f"{v} <> ''")
