"""The three rule packs. They differ in meaning and are chosen by name, never merged."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import lexicon as lx
from inkveil.functions.lexicon import Lexicon
from inkveil.functions.rules import Rule, RulePack, alternation, between, char_class, let, starts

# ---- fixed values: the patterns here and in the packs below are those that results must match ----

# A test of the first character stands before what is dear to test at every place (word borders, what is before); it changes no match.
_LOCAL = r"[a-zA-Z0-9._%+\-]"
# what follows a run of such characters is the same for all places in it, so that only its start (or where the match before ended) needs a try
EMAIL = rf"(?={_LOCAL})(?:\G|(?<!{_LOCAL})){_LOCAL}++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}"
ID18 = r"(?=[1-9])\b[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]\b"
ID15 = r"(?=[1-9])\b[1-9]\d{5}\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}\b"
MOBILE = r"(?=1)\b1[3-9]\d{9}\b"
CARD = r"(?=\d)\b\d{16,19}\b"
LANDLINE = r"0\d{2,3}[-\s]?\d{7,8}"

_MONTH = "(?:0?[1-9]|1[0-2])"
_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
_YEAR_CN = "(?=[0-9〇-四]...年)[0-9〇二三四五六七八九]{4}"
_MONTH_CN = f"(?:{_MONTH}|(?:[一二三四五六七八九十正]|十一|十二)(?=月))"
_DATE_CN = rf"{_YEAR_CN}年{_MONTH_CN}月?[^月\s]+(?=日)日"
_YEAR = "20[12][0-9]"
_JOIN = r"(\s*(?:至|——|[-~])\s*)"


def _numeric_date(separator: str) -> str:
    return f"{_YEAR}{separator}{_MONTH}{separator}{_DAY}"


def _digits_only(pattern: str) -> str:
    """Word boundaries become digit boundaries, so that a number next to a Chinese character is found."""
    first, _, body = pattern.removesuffix(r"\b").partition(r"\b")
    return rf"{first}(?<!\d){body}(?!\d)"


_STREET, _LATIN = "街路道巷弄号", r"\x00-\xFF"


def _address(char: str, other: str, most: int) -> str:
    """Looks ahead for a street's character (two to `most` places on, over characters of an address), without which the many ways to deal out an address are all tried in vain."""
    return f"(?={char}{{2}}{other}{{0,{most}}}+[{_STREET}])"


def branch_rule(names: tuple[str, ...]) -> Rule | None:
    """A known branch's name without what it is (two characters or more), and then a word for what it is, which stays.

    Names end in one of BRANCH_SUFFIXES. Two of them in a row stay together where a known name ends so. A name and its ending are taken as
    long as possible; what stays is then the longest ending of all that was taken.
    """
    ends = lambda n: next((x for x in lx.BRANCH_SUFFIXES if n.endswith(x)), "")
    heads = {n: n.removesuffix(ends(n)) for n in names if ends(n)}
    doubled = {ends(head) + ends(n) for n, head in heads.items() if ends(head) and len(head) - len(ends(head)) >= 2}
    places = [head for head in heads.values() if len(head) >= 2]
    if not places:
        return None
    stays = {*doubled, *lx.BRANCH_SUFFIXES}
    # looking back, a shorter ending would be found first: a group for each length, the longest first
    sizes = sorted({len(x) for x in stays}, reverse=True)
    kept = "|".join(f"(?<=({'|'.join(sorted(x for x in stays if len(x) == n))}))" for n in sizes)
    return Rule("branch", "BANK", f"(?:{alternation(places)})(?:{alternation([*stays])})(?:{kept})", "XX" + "".join(f"${k}" for k in range(1, len(sizes) + 1)))


def g2(lexicon: Lexicon | None = None, strict_digits: bool = False) -> RulePack:
    """The main pack: 24 chained rules and their repairs.

    `$`-anchored dates match only at the end of a text, so that the unit of text (run, cell, paragraph) matters.
    `strict_digits` (an extension) also finds numbers that touch Chinese characters.
    """
    x = lexicon or Lexicon()
    p = x.placeholders
    number = _digits_only if strict_digits else (lambda s: s)
    rules = [
        Rule("email", "EMAIL", EMAIL, p["EMAIL"]),
        Rule("ipv4", "IP", r"(?=\d)\b(?:\d{1,3}\.){3}\d{1,3}\b", p["IP"]),
        Rule("mac", "MAC", r"(?=[0-9A-Fa-f])\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", p["MAC"]),
        Rule("id18", "ID_CARD", number(ID18), p["ID_CARD"]),
        Rule("id15", "ID_CARD", number(ID15), p["ID_CARD"]),
        Rule("mobile", "MOBILE", number(MOBILE), p["MOBILE"]),
        Rule("range_cn", "DATE", rf"{_DATE_CN}(至|——){_DATE_CN}", f"{p['DATE_CHINESE']}$1{p['DATE_CHINESE']}"),
        Rule("range_slash", "DATE", rf"{_numeric_date('/')}{_JOIN}{_numeric_date('/')}$", f"{p['DATE']}$1{p['DATE']}"),
        Rule("range_dash", "DATE", rf"{_numeric_date('-')}{_JOIN}{_numeric_date('-')}$", f"{p['DATE']}$1{p['DATE']}"),
        Rule("date_cn", "DATE", _DATE_CN, p["DATE_CHINESE"]),
        Rule("date_slash", "DATE", rf"{_numeric_date('/')}$", p["DATE"]),
        Rule("date_dash", "DATE", rf"{_numeric_date('-')}$", p["DATE"]),
        Rule("month_cn", "DATE", rf"{_YEAR_CN}年{_MONTH_CN}(?![\s\d一-鿿日])", p["DATE_CHINESE"]),
        Rule("month", "DATE", rf"{_YEAR}年{_MONTH}(?!月?[0-9日])", p["DATE"]),
    ]
    banks = [n[: n.index("银行")] for n in x.bank_names if n.find("银行") > 0]
    if banks:
        rules.append(Rule("bank", "BANK", f"(?:{alternation(banks)})银行", p["BANK"]))
    branch = branch_rule(x.bank_names)
    if branch:
        rules.append(branch)
    if x.bank_names and x.bare_branches:
        rules.append(Rule("bare_branch", "BANK", rf"{starts(x.bare_branches)}(?<![一-龥a-zA-Z0-9])(?:{alternation(x.bare_branches)})(?![一-龥a-zA-Z0-9　-〿＀-￯])", "XX$0"))
    rules += [
        Rule("password_cn", "SECRET", r"(?=密)密码[：:\s]*\d{6,}", "******", True),
        Rule("pwd", "SECRET", r"(?=[p])pwd[：:\s]*[a-zA-Z0-9]{6,}", "******", True),
        Rule("passwd", "SECRET", r"(?=[p])passwd[：:\s]*[a-zA-Z0-9]{6,}", "******", True),
        Rule("passphrase_cn", "SECRET", r"(?=口)口令[：:\s]*[a-zA-Z0-9]{4,}", "******", True),
        Rule("pin", "SECRET", r"(?=[p])pin码?[：:\s]*\d{4,}", "******", True),
    ]
    if x.org_suffixes:
        org = alternation(x.org_suffixes)
        whole = "分行|支行|营业部|科技部|运营部|管理部|董事会|监事会|管委会|事业部"
        rules.append(Rule("org", "ORG", f"(?:{whole})|(?<![一-龥])(?:{org})(?![一-龥])|(?<![一-龥])[一-龥]{{2}}(?:部|科|中心|管委会|办公室)(?![一-龥])", p["ORG"]))
    surname, given = char_class(x.surnames), char_class(x.name_chars)
    rules += [
        Rule("name_a", "NAME", rf"(?={surname})(?<![a-zA-Z0-9]){surname}{given}{{1,2}}(?![a-zA-Z0-9一-龥])", p["NAME"]),
        Rule("name_b", "NAME", rf"(?={surname})(?<=[一-龥：]){surname}{given}{{2}}(?![a-zA-Z0-9一-龥])", p["NAME"]),
    ]
    # three characters before a date must equal the word: one of two characters counts only at the start of the text
    long = [w for w in lx.DUE_WORDS if len(w) == 3]
    short = [w for w in lx.DUE_WORDS if len(w) < 3]
    date = p["DATE_CHINESE"]
    repairs = [Rule(f"repair_{k}", "REPAIR", wrong, right, literal=True) for k, (wrong, right) in enumerate(lx.REPAIRS)]
    repairs += [Rule("due_long", "REPAIR", f"(?<={'|'.join(long)}){date}", lx.DUE_DATE), Rule("due_start", "REPAIR", rf"\A({'|'.join(short)}){date}", f"$1{lx.DUE_DATE}")]
    return RulePack("g2", tuple(rules), repairs=tuple(repairs))


def g1(lexicon: Lexicon | None = None) -> RulePack:
    """The older pack: protected phrases, then ten broad rules (addresses, cards, organisations, any isolated name)."""
    p = (lexicon or Lexicon()).placeholders
    wide = f"[^{_LATIN}]"
    left = r"(?:(?<=[ -~])|(?<=^))(?!有限公司)(?!合作公司)"
    rules = (
        Rule("email", "EMAIL", EMAIL, p["EMAIL"]),
        Rule("address", "ADDRESS", rf"{_address(wide, f'[^{_LATIN}{_STREET}]', 30)}{wide}{{2,6}}(?:省|自治区|市)?{wide}{{0,10}}(?:市|区)?{wide}{{0,10}}(?:街|路|道|巷|弄|号|大道|大街|东路|西路|南路|北路){wide}{{0,30}}", p["ADDRESS"]),
        Rule("id18", "ID_CARD", ID18, p["ID_CARD"]),
        Rule("card", "BANK_CARD", CARD, p["BANK_CARD"]),
        Rule("date", "DATE", rf"(?=[12])(?:\b(?:19|20)\d{{2}}[-/年](?:0[1-9]|1[0-2])[-/月](?:0[1-9]|[12]\d|3[01])日?\b\s*|(?:19|20)\d{{2}}年{_MONTH}月{_DAY}日\b)", p["DATE"]),
        Rule("mobile", "MOBILE", MOBILE, p["MOBILE"]),
        Rule("landline", "PHONE", LANDLINE, p["PHONE"]),
        Rule("bank", "BANK", f"{starts([*lx.G1_BANKS, *lx.G1_LOOSE_BANKS])}(?:(?:{alternation(lx.G1_BANKS)})银行|(?:{alternation(lx.G1_LOOSE_BANKS)}))(?:{wide}{{0,20}}银行)?", p["BANK"]),
        Rule("org", "ORG", f"(?={wide})(?:{left}(?!UAT){wide}{{2,4}}(?:组|部|科|室|处|中心|运营(?![部科]))|{left}{wide}{{2,4}}(?:分行|支行|事业部)|{left}{wide}{{2,4}}公司(?=公司))", p["ORG"]),
        Rule("name", "NAME", "(?=[一-龥])(?<![a-zA-Z0-9一-龥])[一-龥]{2,4}(?!公司|司)(?![a-zA-Z0-9一-龥])(?![：、:])", p["NAME"]),
    )
    phrases = [*lx.PROTECTED_PHRASES, *lx.PROTECTED_COMPANIES]
    return RulePack("g1", rules, protected=tuple((w, f"\x00{k:03d}") for k, w in enumerate(dict.fromkeys(phrases))))


def g3_text(lexicon: Lexicon | None = None) -> RulePack:
    """Text rules of the paragraph pack; names follow by names_g3()."""
    p = (lexicon or Lexicon()).placeholders
    time_range = r"\d{1,2}:\d{2}[-–]\d{1,2}:\d{2}"
    cn = r"\d{4}年\d{1,2}月\d{1,2}日"
    bank = f"(?:{alternation(lx.G3_BANKS)})(?:{alternation(lx.G3_BANK_ENDS)})|(?:{alternation(lx.G3_BARE_BANKS)})"
    # a match whose left neighbour is Chinese is consumed unchanged
    rules = (
        Rule("email", "EMAIL", EMAIL, p["EMAIL"]),
        Rule("address", "ADDRESS", _address("[一-龥]", f"[一-龥&&[^{_STREET}]]", 36) + r"[一-龥]{2,6}(?:省|自治区|市|特别行政区)?[一-龥]{0,10}(?:市|区|县)?[一-龥]{0,10}(?:街|路|道|巷|弄|号|大道|大街|东路|西路|南路|北路)[一-龥0-9\-\s]{0,30}", p["ADDRESS"]),
        Rule("id18", "ID_CARD", ID18, p["ID_CARD"]),
        Rule("card", "BANK_CARD", CARD, p["BANK_CARD"]),
        Rule("date_time", "DATE", rf"{cn}(?!\s)({time_range})", f"{p['DATE']} $1"),
        Rule("date_space_time", "DATE", rf"{cn}(\s+{time_range})", f"{p['DATE']}$1"),
        Rule("date", "DATE", rf"(?=\d{{4}})(?:{cn}|\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{4}}/\d{{1,2}}/\d{{1,2}}|\d{{4}}\.\d{{1,2}}\.\d{{1,2}})", p["DATE"]),
        Rule("mobile", "MOBILE", MOBILE, p["MOBILE"]),
        Rule("landline", "PHONE", LANDLINE, p["PHONE"]),
        Rule("bank", "BANK", f"{starts([*lx.G3_BANKS, *lx.G3_BARE_BANKS])}(?<![一-鿿])(?:{bank})", p["BANK"]),
        Rule("plan", "ORG", "(?=方)(?<![一-鿿])方案(?!介绍)", p["ORG"]),
    )
    return RulePack("g3", rules)


@dataclass(frozen=True)
class NamePass:
    """The name matches of a pattern that pass the validator become XXX; used like a rule.

    Rejected: words that are no names, alone or with the character before; a match that a title or the like follows (its
    text: what stands up to three matches on, at least six characters); fewer than half of the given name's characters known.
    """

    pattern: str
    given: str

    def matches(self, text: Column) -> Column:
        return text.rlike(self.pattern)

    def _walked(self, text: Column, body: Callable[[Column, Column], Column]) -> Column:
        both = F.struct(between(text, self.pattern).alias("pieces"), F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0)).alias("hits"))
        return let(both, lambda b: body(b["pieces"], b["hits"]))

    def _shown(self, pieces: Column, hits: Column) -> Callable[[Column, Column], Column]:
        ends = f"^(?:{alternation(lx.NOT_AFTER_NAME)})"
        compound = f"^(?:{alternation(lx.COMPOUND_SURNAMES)})"

        def shown(h: Column, i: Column) -> Column:
            after = F.concat_ws("", *[c for k in range(3) for c in (F.get(pieces, i + 1 + k), F.get(hits, i + 1 + k))])
            before = F.right(F.concat(F.coalesce(F.get(hits, i - 1), F.lit("")), F.get(pieces, i)), F.lit(1))
            name = F.substring(h, F.when(h.rlike(compound), 3).otherwise(2), F.length(h))
            unknown = F.length(F.translate(name, self.given, ""))
            bad = h.isin(lx.NOT_NAMES) | F.concat(before, h).isin(lx.NOT_NAMES_WITH_BEFORE) | (2 * unknown > F.length(name)) | after.rlike(ends)
            return F.when(bad, h).otherwise(F.lit("XXX"))

        return shown

    def apply(self, text: Column) -> Column:
        def joined(pieces: Column, hits: Column) -> Column:
            shown = self._shown(pieces, hits)
            out = F.transform(pieces, lambda p, i: F.when(i < F.size(hits), F.concat(p, shown(F.get(hits, i), i))).otherwise(p))
            return F.array_join(out, "")

        return F.when(self.matches(text), self._walked(text, joined)).otherwise(text)

    def trace(self, text: Column) -> Column:
        lengths = lambda texts: F.transform(texts, F.length)
        parts = lambda pieces, hits: F.struct(lengths(pieces).alias("gaps"), lengths(hits).alias("sizes"), lengths(F.transform(hits, self._shown(pieces, hits))).alias("news"))
        return self._walked(text, parts)


def names_g3_steps(lexicon: Lexicon | None = None) -> list[Rule | NamePass]:
    """Names by label, then by surname and known given-name characters, then by surname and any validated characters."""
    x = lexicon or Lexicon()
    heads = lambda label: starts(re.match(r"\(\?:(.*?)\)", label)[1].split("|"))
    labels = [Rule(f"label_{k}", "NAME", f"{heads(label)}({label})[一-龥]{{2,4}}", "$1XXX") for k, label in enumerate(lx.NAME_LABELS)]
    compound, single, given = alternation(lx.COMPOUND_SURNAMES), char_class(lx.SINGLE_SURNAMES), char_class(x.given_chars)
    strict = f"(?:(?:{compound}){given}{{1,2}}|{single}{given}{{1,2}})"
    loose = f"(?:(?:{compound})[一-龥]{{2,3}}|{single}[一-龥]{{1,3}})"
    strict, loose = f"(?=[一-龥]){strict}", f"(?=[一-龥]){loose}"
    return [*labels, NamePass(strict, x.given_chars), NamePass(loose, x.given_chars)]


def names_g3(text: Column, lexicon: Lexicon | None = None) -> Column:
    """A text after the steps of `names_g3_steps`."""
    *labels, strict, loose = names_g3_steps(lexicon)
    for label in labels:
        text = label.apply(text)
    return let(text, lambda t: let(strict.apply(t), loose.apply))


def steps(pack: str = "g2", lexicon: Lexicon | None = None) -> list[Rule | NamePass]:
    """All steps of the pack named g1, g2 or g3, in order."""
    if pack == "g3":
        return [*g3_text(lexicon).steps, *names_g3_steps(lexicon)]
    return {"g1": g1, "g2": g2}[pack](lexicon).steps


def filename_g3(name: Column) -> Column:
    """A file name with banks, dates and mobile numbers masked."""
    bank = f"(?:{alternation(lx.G3_BANKS)})(?:{alternation(lx.G3_BANK_ENDS)})|(?:{alternation(lx.G3_BARE_BANKS)})"
    for pattern, mask in ((bank, "XX银行"), (r"\d{4}[-_年]\d{1,2}[-_月]\d{1,2}日?", "XXXX/XX/XX"), (r"1[3-9]\d{9}", "XXXXXXXXXXX")):
        name = F.regexp_replace(name, F.lit(pattern), F.lit(mask))
    return name


def redact(text: Column, pack: str = "g2", lexicon: Lexicon | None = None) -> Column:
    """A text under the pack named g1, g2 or g3."""
    if pack == "g3":
        return names_g3(g3_text(lexicon).apply(text), lexicon)
    return {"g1": g1, "g2": g2}[pack](lexicon).apply(text)
