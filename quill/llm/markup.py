"""Markup residue: structured reading of HTML, Markdown, wiki and LaTeX texts.

The markup language is told from the text (labels are often wrong); a reader for it cuts the text into blocks: heading,
list item, code block, formula, and prose. All blocks are classified in two passes by stop-word density (where a list
fits the script and the language), length and link density: the first pass decides clear blocks, the second lets short
or ambiguous blocks inherit the label of their nearest decided neighbours. Elements and clean texts are made of the
blocks labelled content alone: a menu's items are no elements, and the heading above a menu goes with it.

Defined results: texts without markup have no elements and come out unchanged; null stays null; an unclosed element
ends where the next block begins.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_latex = re.compile(r"\\(?:documentclass|usepackage|begin|end|item|section|subsection|subsubsection|chapter|paragraph|textbf|textit|texttt|underline|emph|href|url|footnote|cite|label|ref|noindent|maketitle)\b|\\['~^\"`=]\{?\\?[a-zA-Z]|\\c\{|\{\\(?:it|bf|em|tt)\b")
_html = re.compile(r"</?(?:p|span|h[1-6]|li|ul|ol|dl|dt|dd|a|b|i|u|em|strong|small|sub|sup|div|section|article|nav|footer|header|td|tr|th|table|tbody|thead|pre|code|br|hr|img|html|head|body|title|style|script|blockquote|font|center|meta|link)(?:\s[^<>]*)?/?>|&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z]{2,8});|<!--")
_html_any_case = re.compile(_html.pattern, re.I)
# each sign with plain strings one of which a text with it holds: those are found faster than a pattern
_wiki_signs = [
    (("[[",), re.compile(r"\[\[[^\]\n]+\]\]")),
    (("{{",), re.compile(r"\{\{[^{]")),
    (("''",), re.compile(r"''\S")),
    (("<ref", "<math", "<syntaxhighlight", "<nowiki", "<source", "<gallery"), re.compile(r"<(?:ref|math|syntaxhighlight|nowiki|source|gallery)\b")),
    (("=\n", "\n="), re.compile(r"^(={1,6})[^=\n]+\1[^\S\n]*$", re.M)),
    (("[http",), re.compile(r"(?<![\]\w])\[https?://[^\s\]]+ [^\]\n]+\]")),
]
_markdown_signs = [
    (("#",), re.compile(r"^#{1,6}[^\S\n]+\S", re.M)),
    (("```", "~~~"), re.compile(r"^(?:```|~~~)", re.M)),
    (("**",), re.compile(r"\*\*[^\s*][^*\n]*\*\*")),
    (("__",), re.compile(r"(?<!\w)__[^\s_][^_\n]*__(?!\w)")),
    (("](",), re.compile(r"\[[^\]\n]*\]\([^)\s]+\)")),
    (("]: http", "]:http"), re.compile(r"(?:^|\s)\[\w+\]: ?https?:", re.M)),
    (("\n---", "\n==="), re.compile(r"^\S[^\n]*\n(?:-{3,}|={3,})[^\S\n]*$", re.M)),
    (("*",), re.compile(r"(?<![\w*\\])\*[^\s*][^*\n]*\*(?![\w*])")),
    (("_",), re.compile(r"(?<![\w_\\])_[^\s_][^_\n]*_(?![\w_])")),
    (("`",), re.compile(r"`[^`\n]+`")),
    (("$",), re.compile(r"\$\$[^$]+\$\$|(?<![\w$])\$(?!\s)[^$\n]+?(?<!\s)\$(?![\w$])")),
    (("\n- ", "\n* ", "\n+ ", " - ", " * ", " + "), re.compile(r"^[^\S\n]*[-+*] +[^\s\d\-*+][^\n]*\n[^\S\n]*[-+*] +[^\s\d\-*+]", re.M)),
]


def _shows(text: str, signs: list) -> bool:
    return any(any(x in text for x in plain) and pattern.search(text) for plain, pattern in signs)


#: Characters without one of which a text holds no markup.
HINT = r"[<\\&*_`#$=\[{+\-]|''"


def language(text: str) -> str | None:
    """'latex', 'wiki', 'html', 'markdown' or None."""
    if "\\" in text and _latex.search(text):
        return "latex"
    if _shows(text, _wiki_signs):
        return "wiki"
    if ("<" in text or "&" in text) and _html_any_case.search(text):
        return "html"
    return "markdown" if _shows(text, _markdown_signs) else None


@dataclass
class Block:
    kind: str  # heading, list_item, code_block, formula or prose
    content: str
    level: int = 0
    links: int = 0  # characters of link text


_space = re.compile(r"\s+")


def squeeze(text: str) -> str:
    return _space.sub(" ", text).strip()


FORMULA = "\ue000"  # stands for a formula in running text; its number follows, then the mark again
_kept = re.compile(FORMULA + r"(\d+)" + FORMULA)


class Reader:
    """Collects blocks of one text; formulas are lifted out of running text in order."""

    def __init__(self, plain):
        self.plain, self.blocks, self.formulas = plain, [], []

    def lift(self, source: str) -> str:
        self.formulas.append(squeeze(source))
        return f" {FORMULA}{len(self.formulas) - 1}{FORMULA} "

    def add(self, kind: str, raw: str, level: int = 0) -> None:
        text, links = self.plain(raw)
        for m in _kept.finditer(text):
            self.blocks.append(Block("formula", self.formulas[int(m.group(1))]))
        text = squeeze(_kept.sub(lambda m: self.formulas[int(m.group(1))] if kind == "heading" or kind == "list_item" else " ", text))
        if text:
            self.blocks.append(Block(kind, text, level, links))

    def code(self, source: str) -> None:
        if source.strip():
            self.blocks.append(Block("code_block", source.strip("\n")))

    def paragraphs(self, raw: str) -> None:
        for part in re.split(r"\n[^\S\n]*\n", raw):
            if part.strip():
                self.add("prose", part)


# HTML

_drop_html = re.compile(r"<!--.*?-->|<head\b.*?</head\s*>|<(style|script|noscript|title)\b.*?</\1\s*>|<!DOCTYPE[^>]*>", re.S | re.I)
_html_math = re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)|<math\b[^>]*>(.*?)</math\s*>", re.S | re.I)
_html_block = re.compile(r"<pre\b[^>]*>(?P<pre>.*?)(?:</pre\s*>|\Z)|<h(?P<n>[1-6])\b[^>]*>(?P<h>.*?)(?:</h[1-6]\s*>|(?=<(?:p|h[1-6]|ul|ol|div|pre)\b)|\Z)|<li\b[^>]*>(?P<li>.*?)(?=</?(?:li|ul|ol|p|div|pre|body|html|h[1-6])\b|\Z)|(?P<cut></?(?:p|div|ul|ol|li|table|tr|td|th|tbody|thead|body|html|blockquote|section|article|nav|footer|header|dl|dt|dd|hr)\b[^>]*>|<br\s*/?>\s*<br\s*/?>)", re.S | re.I)
_tag = re.compile(r"</?[a-zA-Z][^<>]*>")
_anchor = re.compile(r"<a\b[^>]*>(.*?)</a\s*>", re.S | re.I)


def _plain_html(raw: str) -> tuple[str, int]:
    links = sum(len(m) for m in _anchor.findall(raw)) if "<a" in raw or "<A" in raw else 0
    text = re.sub(r"<br\s*/?>|<img\b[^>]*>", " ", raw, flags=re.I)
    return html.unescape(_tag.sub("", text)).replace("\xa0", " "), links


def read_html(text: str) -> list[Block]:
    r = Reader(_plain_html)
    text = _drop_html.sub("\n", text)
    codes: list[str] = []

    def hide(m):
        codes.append(m.group(0))
        return f"\ue001{len(codes) - 1}\ue001"

    text = re.sub(r"<pre\b[^>]*>.*?</pre\s*>", hide, text, flags=re.S | re.I)
    text = _html_math.sub(lambda m: r.lift(html.unescape(_tag.sub("", next(g for g in m.groups() if g is not None)))), text)
    text = re.sub("\ue001(\\d+)\ue001", lambda m: codes[int(m.group(1))], text)
    at = 0
    for m in _html_block.finditer(text):
        r.paragraphs(text[at : m.start()])
        at = m.end()
        if m.group("pre") is not None:
            r.code(html.unescape(_tag.sub("", m.group("pre"))))
        elif m.group("h") is not None:
            r.add("heading", m.group("h"), int(m.group("n")))
        elif m.group("li") is not None:
            r.add("list_item", m.group("li"))
    r.paragraphs(text[at:])
    return r.blocks


# Wiki

_wiki_code = re.compile(r"<(syntaxhighlight|source|pre)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
_wiki_math = re.compile(r"<math\b[^>]*>(.*?)</math\s*>", re.S | re.I)
_wiki_heading = re.compile(r"(={1,6})\s*(.+?)\s*\1\s*\Z")
_wiki_item = re.compile(r"([*#]+)[:;]*\s*(.*)\Z")


def _templates(text: str) -> str:
    """text without {{...}}, nested ones and tables included."""
    text = re.sub(r"\{\|.*?\|\}", "\n", text, flags=re.S)
    while True:
        less = re.sub(r"\{\{[^{}]*\}\}", "", text)
        if less == text:
            return text
        text = less


def _plain_wiki(raw: str) -> tuple[str, int]:
    links = 0

    def link(m):
        nonlocal links
        links += len(m.group(1))
        return m.group(1)

    text = re.sub(r"<ref\b[^>/]*/>|<ref\b[^>]*>.*?</ref\s*>", "", raw, flags=re.S | re.I)
    text = re.sub(r"\[\[(?:Categor[^:\]]*|Category|Kategorie|Catégorie|Categoria|File|Image|Archivo|Fichier|Datei|Ficheiro|Категория|Файл|分类|分類|文件|カテゴリ|ファイル|تصنيف|ملف|श्रेणी|หมวดหมู่):[^\]]*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", link, text)
    text = re.sub(r"\[(?:https?|ftp)://[^\s\]]+\s+([^\]]*)\]", link, text)
    text = re.sub(r"\[(?:https?|ftp)://[^\s\]]+\]", "", text)
    text = re.sub(r"'{2,5}|__[A-Z]+__", "", text)
    text = re.sub(r"<br\s*/?>", " ", text, flags=re.I)
    return html.unescape(_tag.sub("", text)).replace("\xa0", " "), links


def read_wiki(text: str) -> list[Block]:
    r = Reader(_plain_wiki)
    codes: list[str] = []

    def hide(m):
        codes.append(m.group(2))
        return f"\n\ue001{len(codes) - 1}\n"

    text = _wiki_code.sub(hide, re.sub(r"<!--.*?-->", "", text, flags=re.S))
    text = _templates(_wiki_math.sub(lambda m: r.lift(m.group(1)), text))
    prose: list[str] = []

    def flush():
        if prose:
            r.add("prose", "\n".join(prose))
            prose.clear()

    for line in text.split("\n"):
        s = line.strip()
        if s[:1] == "\ue001":
            flush()
            r.code(codes[int(s[1:])])
        elif s[:1] == "=" and (m := _wiki_heading.match(s)):
            flush()
            r.add("heading", m.group(2), len(m.group(1)))
        elif s[:1] in ("*", "#") and (m := _wiki_item.match(s)):
            flush()
            r.add("list_item", m.group(2), len(m.group(1)))
        elif not s:
            flush()
        else:
            prose.append(line.lstrip(":;") if s[:1] in ":;" else line)
    flush()
    return r.blocks


# LaTeX

#: Accent commands and the combining character each stands for.
ACCENTS = {"'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃", "=": "̄", "c": "̧", "v": "̌", "u": "̆", "H": "̋", "r": "̊", "k": "̨", ".": "̇"}
#: Commands that stand for a character.
LETTERS = {"i": "i", "j": "j", "ss": "ß", "ae": "æ", "oe": "œ", "o": "ø", "aa": "å", "l": "ł", "AE": "Æ", "OE": "Œ", "O": "Ø", "AA": "Å", "L": "Ł", "ldots": "...", "dots": "...", "textquotedblleft": "“", "textquotedblright": "”", "guillemotleft": "«", "guillemotright": "»", "textendash": "–", "textemdash": "—", "S": "§", "copyright": "©", "pounds": "£", "euro": "€", "textbackslash": "\\"}
_accent = re.compile(r"\\(?:(['`^\"~=.])\s*(?:\{\s*\\?([a-zA-Z])\s*\}|\\([ij])(?![a-zA-Z])\s?|([a-zA-Z]))|([cvuHrk])(?:\{\s*\\?([a-zA-Z])\s*\}|\s+([a-zA-Z])))")
_latex_code = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]]*\])?(?:(?<=minted\})\{[^}]*\})?(.*?)\\end\{\1\}", re.S)
_latex_math = re.compile(r"\\begin\{(equation|align|displaymath|eqnarray|gather|multline|math)(\*?)\}(.*?)\\end\{\1\2\}|\\\[(.+?)\\\]|\\\((.+?)\\\)|\$\$(.+?)\$\$|(?<![\\$])\$(?!\s)([^$\n]+?)(?<![\\\s])\$", re.S)
_latex_block = re.compile(r"\\(?P<head>(?:sub)*section|chapter|part|(?:sub)?paragraph)\*?\s*(?:\[[^\]]*\])?\{|\\item\b\s*(?:\[[^\]]*\])?|\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?|\ue001(?P<code>\d+)\ue001|(?P<gap>\n[^\S\n]*\n)")


def _closing(text: str, at: int) -> int:
    """Place of the brace that closes the one before ``at``."""
    depth = 1
    while at < len(text):
        ch = text[at]
        if ch == "\\":
            at += 1
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if not depth:
                return at
        at += 1
    return len(text)


def _accented(text: str) -> str:
    def compose(m):
        mark = m.group(1) or m.group(5)
        letter = m.group(2) or m.group(3) or m.group(4) or m.group(6) or m.group(7)
        return unicodedata.normalize("NFC", letter + ACCENTS[mark])

    return _accent.sub(compose, text) if "\\" in text else text


def _plain_latex(raw: str) -> tuple[str, int]:
    links = 0

    def link(m):
        nonlocal links
        links += len(m.group(1))
        return m.group(1)

    text = _accented(raw)
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    text = re.sub(r"~?\\(?:cite[tp]?|label|ref|eqref|pageref|index|bibliography|bibliographystyle|usepackage|documentclass|includegraphics|vspace|hspace|input|pagestyle|footnote)\*?(?:\[[^\]]*\])*\{(?:[^{}]|\{[^{}]*\})*\}", "", text)
    for _ in range(4):
        less = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", link, text)
        less = re.sub(r"\\(?:text\w+|emph|underline|mbox|textsc|title|author|date|url|caption|enquote)\{([^{}]*)\}", r"\1", less)
        less = re.sub(r"\{\\(?:it|bf|em|tt|sc|rm|sl|small|large|Large)\b\s*([^{}]*)\}", r"\1", less)
        if less == text:
            break
        text = less
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", " ", text)
    text = re.sub(r"\\([a-zA-Z]+)\*?(?:\{\})?\s?", lambda m: LETTERS.get(m.group(1), ""), text)
    text = re.sub(r"\\([%&#_{}$ ])", r"\1", text.replace("~", " "))
    text = re.sub(r"(?<!\\)[{}]", "", text)
    return text.replace("``", "“").replace("''", "”"), links


def read_latex(text: str) -> list[Block]:
    r = Reader(_plain_latex)
    codes: list[str] = []

    def hide(m):
        codes.append(m.group(2))
        return f"\n\n\ue001{len(codes) - 1}\ue001\n\n"

    text = _latex_code.sub(hide, text)
    text = _latex_math.sub(lambda m: r.lift(next(g for g in m.groups()[2:] if g is not None)), text)
    at, kind = 0, "prose"
    m = _latex_block.search(text)
    while m:
        piece = text[at : m.start()]
        if piece.strip():
            r.add(kind, piece)
        kind, at = "prose", m.end()
        if m.group("head"):
            end = _closing(text, m.end())
            r.add("heading", text[m.end() : end], 1 + m.group("head").count("sub"))
            at = min(len(text), end + 1)
        elif m.group("code"):
            r.code(codes[int(m.group("code"))])
        elif m.group(0).startswith("\\item"):
            kind = "list_item"
        m = _latex_block.search(text, at)
    if text[at:].strip():
        r.add(kind, text[at:])
    return r.blocks


# Markdown

_fence = re.compile(r"\s{0,3}(`{3,}|~{3,})")
_hashes = re.compile(r"\s{0,3}(#{1,6})\s+(.*?)(?:\s+#+)?\s*\Z")
_item = re.compile(r"(\s*)(?:[-+*]|(\d{1,4})[.)])\s+(.*)\Z")
_under = re.compile(r"\s{0,3}(?:=+|-{2,})\s*\Z")
_md_math = re.compile(r"\$\$(.+?)\$\$|(?<![\w$\\])\$(?!\s)([^$\n]+?)(?<![\s\\])\$(?![\w$])|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)


def _plain_markdown(raw: str) -> tuple[str, int]:
    links = 0

    def link(m):
        nonlocal links
        links += len(m.group(1))
        return m.group(1)

    text = re.sub(r"!\[[^\]\n]*\]\([^)\n]*\)", "", raw)
    text = re.sub(r"\[([^\]\n]*)\]\([^)\n]*\)", link, text)
    text = re.sub(r"\[\^?\w+\]:\s*\S+(?:\s+\"[^\"\n]*\")?", "", text)
    text = re.sub(r"\[([^\]\n]+)\]\[[^\]\n]*\]", link, text)
    text = re.sub(r"\[\^\w+\]|<(?:https?://[^>\s]+)>", "", text)
    text = re.sub(r"(`+)(.+?)\1", r"\2", text)
    for mark in (r"\*\*\*", r"\*\*", r"__", r"~~"):
        text = re.sub(rf"(?<!\\){mark}(?=\S)(.+?)(?<=\S){mark}", r"\1", text, flags=re.S)
    text = re.sub(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])", r"\1", text)
    text = re.sub(r"(?<![\w_\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])", r"\1", text)
    text = re.sub(r"\\([\\`*_{}\[\]()#+\-.!|>~$])", r"\1", text)
    if "&" in text or "<" in text:
        text = html.unescape(re.sub(r"<br\s*/?>", " ", text)).replace("\xa0", " ")
    return text, links


def read_markdown(text: str) -> list[Block]:
    r = Reader(_plain_markdown)
    codes: list[str] = []
    lines, out = text.split("\n"), []
    i = 0
    while i < len(lines):  # fenced code first, so that nothing in it is read as markup
        if m := _fence.match(lines[i]):
            j = i + 1
            while j < len(lines) and not re.match(r"\s{0,3}" + re.escape(m.group(1)) + r"+\s*\Z", lines[j]):
                j += 1
            codes.append("\n".join(lines[i + 1 : j]))
            out += ["", f"\ue001{len(codes) - 1}", ""]
            i = j + 1
        else:
            out.append(lines[i])
            i += 1
    lines = _md_math.sub(lambda m: r.lift(next(g for g in m.groups() if g is not None)), "\n".join(out)).split("\n")
    prose: list[str] = []
    listing = False

    def flush():
        if prose:
            r.add("prose", "\n".join(prose))
            prose.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        s = line.strip()
        if not s:
            flush()
            listing = False
        elif s[0] == "\ue001":
            flush()
            r.code(codes[int(s[1:])])
        elif m := _hashes.match(line):
            flush()
            r.add("heading", m.group(2), len(m.group(1)))
        elif (m := _item.match(line)) and (listing or not prose or not m.group(2)):
            flush()
            r.add("list_item", m.group(3), len(m.group(1)))
            listing = True
        elif not prose and i + 1 < len(lines) and _under.match(lines[i + 1]) and not _under.match(line):
            flush()
            r.add("heading", s, 1 if "=" in lines[i + 1] else 2)
            i += 1
        elif _under.match(line) and len(s) >= 3:
            flush()
        else:
            prose.append(re.sub(r"\A\s{0,3}>\s?", "", line))
        i += 1
    flush()
    return r.blocks


READERS = {"html": read_html, "wiki": read_wiki, "latex": read_latex, "markdown": read_markdown}

#: Frequent function words by script. The five Latin-script languages share many and so have one list.
STOP_WORDS = {
    "latin": frozenset(
        "de la el en y los las del un una con por para que se a su al o the of and to in for on with that by is at as from or its "
        "le les des du et est dans pour par sur une au aux que der die das und von des im den mit für ein eine zu auf dem nach "
        "o os da do dos das em e um uma com por no na nos nas".split()
    ),
    "cyrillic": frozenset(
        "и в во на с со по из за не к ко для о об от до у при под над после перед между без через что чтобы как это этот эта эти этого этой а но "
        "или же бы ли то так также был была было были его её ее их он она они мы я вы который которая которое которые которых все всех кто если "
        "когда уже ещё еще только".split()
    ),
    "arabic": frozenset(
        "في من على إلى عن مع أن إن التي الذي الذين هذا هذه ذلك تلك بعد قبل بين كما لا لم لن ما كان كانت قد وقد أو ثم كل خلال حتى عند غير دون تحت فوق "
        "ومن وفي منذ أي هو هي هل وهو وهي لكن بسبب حول ضد منها فيه فيها".split()
    ),
    "devanagari": frozenset(
        "के की का में से और को ने है हैं पर यह वह एक लिए कि ही भी तो था थी थे इस उस जो या नहीं ये वे अपने अपनी अपना किया गया बाद तक साथ कर हो इन उन कोई कुछ "
        "बिना".split()
    ),
}
#: Densities of stop words from which a long block, or a short one, is text: es, en, pt, fr, de together, ru, ar, hi.
LOW_STOPS = {"latin": 0.1, "cyrillic": 0.05, "arabic": 0.09, "devanagari": 0.2}
HIGH_STOPS = {"latin": 0.22, "cyrillic": 0.12, "arabic": 0.18, "devanagari": 0.3}
GOOD_LENGTH, SHORT_LENGTH = 140, 70
#: Shares of link text above which prose, or a whole list, is a menu.
HIGH_LINKS, LIST_LINKS = 0.4, 0.8
#: Items of nothing but links from which a list is a menu; a shorter one is ambiguous.
MENU_ITEMS = 3

_marks = "".join(c for c in map(chr, range(0x300, 0x20000)) if unicodedata.category(c)[0] == "M")
#: Words; vowel signs and other combining marks belong to them.
_words = re.compile(rf"\w[\w{_marks}]*")
_scripts = {
    "latin": re.compile("[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]"),
    "cyrillic": re.compile("[Ѐ-ԯ]"),
    "arabic": re.compile("[\u0620-\u064a\u066e-\u06d3\u0750-\u077f]"),
    "devanagari": re.compile("[\u0904-\u0939\u0958-\u0961]"),
    "ideographic": re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]"),
}


def script_of(text: str) -> str:
    """The script of most letters: one of _scripts or 'other'; 'latin' where there are none."""
    letters = sum(map(str.isalpha, text))
    best, most = "latin", 0
    for name, pattern in _scripts.items():
        n = len(pattern.findall(text))
        letters -= n
        if n > most:
            best, most = name, n
    return "other" if letters > most else best


def _units(blocks: list[Block]) -> list[list[int]]:
    """What is classified as one block: the items of a list together, everything else by itself."""
    out: list[list[int]] = []
    for i, b in enumerate(blocks):
        if b.kind == "list_item" and out and blocks[i - 1].kind == "list_item":
            out[-1].append(i)
        else:
            out.append([i])
    return out


def decide(blocks: list[Block]) -> list[bool]:
    """Whether each block is content: clear ones first, then short or ambiguous ones as their nearest decided neighbours.

    Link density decides first, of a list over all its items. Code and formulas are content, headings always ambiguous.
    Stop words speak for a long block and, in prose, against it, but only where a list of them fits: the script has one, and
    all blocks of that script in the text together reach its density. Long blocks of other scripts and languages are
    content unless they consist of links.
    """
    units = _units(blocks)
    measured: list[tuple[str, int, int, int, int] | None] = []
    whole: dict[str, list[int]] = {}
    for unit in units:
        if blocks[unit[0]].kind in ("code_block", "formula"):
            measured.append(None)
            continue
        content = " ".join(blocks[i].content for i in unit)
        script = script_of(content)
        words = _words.findall(content.lower())
        stops = sum(w in STOP_WORDS[script] for w in words) if script in STOP_WORDS else 0
        measured.append((script, len(words), stops, len(content), sum(blocks[i].links for i in unit)))
        total = whole.setdefault(script, [0, 0])
        total[0] += len(words)
        total[1] += stops
    fits = {script for script, (words, stops) in whole.items() if script in STOP_WORDS and stops >= LOW_STOPS[script] * max(1, words)}
    labels: list[bool | None] = []
    for unit, m in zip(units, measured):
        if m is None:
            labels.append(True)
            continue
        script, words, stops, size, links = m
        kind = blocks[unit[0]].kind
        if links > (LIST_LINKS if kind == "list_item" else HIGH_LINKS) * size:
            labels.append(None if kind == "list_item" and len(unit) < MENU_ITEMS else False)
        elif kind == "heading":
            labels.append(None)
        elif script == "ideographic" or words * 12 <= size and script in STOP_WORDS:
            labels.append(True if size >= SHORT_LENGTH // 3 else None)
        elif script not in fits:
            labels.append(True if size >= GOOD_LENGTH else None)
        elif size >= GOOD_LENGTH:
            labels.append(True if stops >= LOW_STOPS[script] * words else None if kind == "list_item" else False)
        else:
            labels.append(True if size >= SHORT_LENGTH and stops >= HIGH_STOPS[script] * words else None)
    out = [True] * len(blocks)
    decided = [n for n, x in enumerate(labels) if x is not None]
    at = 0
    for n, x in enumerate(labels):
        while at < len(decided) and decided[at] < n:
            at += 1
        if x is None:
            near = ([decided[at - 1]] if at else []) + ([decided[at]] if at < len(decided) else [])
            least = min((abs(d - n) for d in near), default=0)
            # of neighbours equally near content wins; without any the block is content
            x = any(labels[d] for d in near if abs(d - n) == least) if near else True
        for i in units[n]:
            out[i] = x
    return out


def render(blocks: list[Block]) -> str:
    """Clean text: headings under #, items under -, code between fences, formulas between $$."""
    out: list[str] = []
    previous = ""
    for b, keep in zip(blocks, decide(blocks)):
        if not keep:
            continue
        line = {"heading": "#" * max(1, min(6, b.level)) + " ", "list_item": "- ", "formula": "$$", "code_block": "```\n"}.get(b.kind, "") + b.content + {"formula": "$$", "code_block": "\n```"}.get(b.kind, "")
        out.append(("\n" if b.kind == previous == "list_item" else "\n\n") + line)
        previous = b.kind
    return "".join(out).strip()


def elements_of(text: str) -> list[tuple[str, str]]:
    """The markup language, and the structural elements among the blocks that the two passes label content."""
    kind = language(text)
    if kind is None:
        return []
    found = {("residue", kind): None}
    blocks = READERS[kind](text)
    for b, content in zip(blocks, decide(blocks)):
        if content and b.kind != "prose":
            found[b.kind, squeeze(b.content)] = None
    return list(found)


def elements(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, element, content): markup language and structural elements of each text, distinct."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, names, contents = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for e, c in elements_of(t.replace("\r\n", "\n")):
                    rows.append(i)
                    names.append(e)
                    contents.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(contents, pa.string())], ["key", "element", "content"])

    part = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(HINT))
    return part.mapInArrow(run, f"key {kind}, element string, content string").withColumnRenamed("key", key)


def clean(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, markup, text): each text without markup, its structure kept in one plain notation."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            marks, texts = [], []
            for t in batch.column(1).to_pylist():
                mark = language(t) if t else None
                marks.append(mark)
                texts.append(render(READERS[mark](t.replace("\r\n", "\n"))) if mark else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string()), pa.array(texts, pa.string())], ["key", "markup", "text"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, markup string, text string").withColumnRenamed("key", key)


def prose(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block int, script, size int, kept boolean): the label of each prose block of each text with markup."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if mark := language(t):
                    blocks = READERS[mark](t.replace("\r\n", "\n"))
                    own = [(n, script_of(b.content), len(b.content), keep) for n, (b, keep) in enumerate(zip(blocks, decide(blocks))) if b.kind == "prose"]
                    rows += [i] * len(own)
                    out += own
            n, script, size, kept = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int32()), pa.array(script, pa.string()), pa.array(size, pa.int32()), pa.array(kept, pa.bool_())], ["key", "block", "script", "size", "kept"])

    part = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(HINT))
    return part.mapInArrow(run, f"key {kind}, block int, script string, size int, kept boolean").withColumnRenamed("key", key)
