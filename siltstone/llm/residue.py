"""Template residue, filler, error pages and script notices in place of content.

One multi-pattern automaton holds phrases of several languages, the words of
usual filler, and the opening marks of placeholders.  A text is cut into
sentences; the automaton tells how much of each is covered, and a document is
residue when the sentences so covered make up most of it, title and navigation
left aside.  Unfilled placeholders count wherever they stand outside code: where
the automaton meets an opening mark, the shape of what follows decides.
"""

from __future__ import annotations

import html
import unicodedata

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.session import task_udf

# Phrases, lower case, by what they show.
PHRASES = {
    "error_page": """
        page not found|not found|page cannot be found|page could not be found|this page is gone|page does not exist
        no longer exists|has moved or never existed|never existed|the page you are looking for|the page you requested
        could not find what you asked for|we could not find|we couldn't find|link you followed may be broken
        check the address for typing mistakes|check the url|slipped through our fingers|site unavailable
        service unavailable|temporarily unavailable|bad gateway|gateway timeout|gateway time-out|forbidden|unauthorized
        internal server error|server error|access denied|access to this page has been denied|permission denied
        do not have permission|you don't have permission|permission to view this resource|too many requests
        rate limit exceeded|something went wrong|an error occurred|an error has occurred|unexpected error|oops|whoops
        error 400|error 401|error 403|error 404|error 410|error 429|error 500|error 502|error 503|error 504
        400 bad request|401 unauthorized|403 forbidden|404 not found|410 gone|500 internal server error|502 bad gateway
        503 service unavailable|504 gateway timeout|unable to connect|connection refused|this site can't be reached
        account suspended|this account has been suspended|domain expired|this domain is for sale|domain is for sale
        domain has expired|is parked|down for planned maintenance|down for maintenance|under maintenance
        server met a problem|could not finish your request|upstream server|server gave no answer|gave no answer|no answer in time|did not answer
        has been told about the problem|our team has been notified|address has been blocked|blocked for unusual traffic
        unusual traffic|not available in your area|not available in your country|not available in your region
        content is not available|content unavailable|please try again in a few minutes|try again later
        please try again|owner of this site has not finished|back to start|go to the home page|go back home
        return to the homepage|back to home|contact support|request could not be completed|session has expired
        seite nicht gefunden|seite wurde nicht gefunden|zugriff verweigert|angeforderte adresse gibt es
        angeforderte seite|auf diesem server nicht|interner serverfehler|dienst nicht verfügbar|nicht verfügbar
        zur startseite|ein fehler ist aufgetreten|zu viele anfragen|page introuvable|page demandée n'existe
        n'existe plus|accès refusé|accès interdit|erreur interne|une erreur est survenue|une erreur s'est produite
        retour à l'accueil|trop de requêtes|service indisponible|página no encontrada|no se encontró la página
        dirección solicitada no existe|no existe|acceso denegado|error interno|ha ocurrido un error
        volver al inicio|demasiadas solicitudes|servicio no disponible|pagina non trovata|accesso negato
        si è verificato un errore|página não encontrada|acesso negado|ocorreu um erro|pagina niet gevonden
        toegang geweigerd|sidan hittades inte|страница не найдена|доступ запрещен|доступ запрещён|произошла ошибка
        ページが見つかりません|アクセスが拒否されました|页面不存在|页面未找到|找不到页面|访问被拒绝|发生错误
        페이지를 찾을 수 없습니다|الصفحة غير موجودة|η σελίδα δεν βρέθηκε
        """,
    "script_notice": """
        enable javascript|javascript is required|javascript required|requires javascript|javascript is disabled
        javascript is not enabled|javascript is turned off|javascript must be enabled|turn on javascript
        need to enable javascript|does not run javascript|doesn't run javascript|does not support javascript
        allow javascript|activate javascript|without javascript|javascript, or it is switched off
        turn on scripts|turn scripts on|enable scripts|scripts switched on|scripts are blocked|scripts are off
        while scripts are off|only with scripts|enable cookies and scripts|cookies and scripts|enable cookies
        cookies must be allowed|allow them and reload|to view this page|required for this application to run
        in your browser to continue|app cannot run|application cannot run|cannot run without|will not work without|to proceed to the article|checking your browser
        your browser is being checked|browser is being checked|one moment|just a moment|verify you are human
        verifying you are human|whether you are a person|this takes a moment|are you a robot|i am not a robot
        complete the captcha|security check|protected by|ddos protection by|unsupported browser
        your browser is not supported|browser is out of date|reload the page|reload the page once you have done so
        if you are not redirected|press here|follow these steps to change your settings|change your settings
        aktivieren sie javascript|javascript aktivieren|bitte aktivieren sie|um diese seite zu sehen
        javascript ist deaktiviert|javascript wird benötigt|activer javascript|activez javascript|veuillez activer
        pour afficher cette page|javascript est désactivé|javascript est requis|active javascript
        activa javascript|active javascript para continuar|habilite javascript|habilita javascript
        javascript está desactivado|necesita javascript|abilita javascript|attiva javascript|ative o javascript
        habilite o javascript|schakel javascript in|aktivera javascript|включите javascript|javascript отключен
        javascriptを有効にしてください|javascript を有効にしてください|请启用 javascript|请启用javascript
        javascript를 활성화|يرجى تفعيل javascript|ενεργοποιήστε τη javascript|ενεργοποιήστε το javascript
        """,
    "filler": """
        lorem ipsum|dolor sit amet|consectetur adipiscing|your text here|text goes here|sample text|dummy content
        dummy text|placeholder copy|body copy|placeholder text|placeholder content|filler text|insert text here|add your text
        content goes here|title goes here|description goes here|coming soon|under construction|watch this space
        check back soon|check back in a few days|check back later|no content yet|nothing here yet|content to follow
        description to follow|text to follow|details to follow|will be added later|will be added soon|to be announced
        to be added|to be determined|tbd|tba|this is an example entry|this is an example page|this is a sample page
        this is a test|replace it with your own words|replace this text|hello there|hello world|another new site
        just another site|another new blog|has not finished|not finished setting it up|still being set up|asdf|qwerty|test test|foo bar|foo bar baz
        hier entsteht eine neue|hier entsteht|platzhaltertext|beispieltext|blindtext|folgt in kürze|demnächst
        in kürze verfügbar|contenido próximamente|próximamente|texto de ejemplo|texto de relleno|en construcción
        en construction|bientôt disponible|contenu à venir|texte à venir|texte d'exemple|faux texte|prossimamente
        in costruzione|em breve|em construção|binnenkort beschikbaar|kommer snart|скоро здесь будет|скоро открытие
        準備中|近日公開|工事中|建设中|敬请期待|준비 중|قريبا|σύντομα διαθέσιμο
        """,
    "chrome": """
        newsletter|archive|terms|cookie settings|contact|imprint|topics|sign in|home|about|follow us|search|retry
        need help?|help|write to us|write to the|site team|contact us|loading|log in|login|sign up|register|subscribe|menu|privacy|privacy policy
        legal notice|cookies|share|skip to content|skip to main content|all rights reserved|copyright|code|message|status
        error|detail|title|reference|request id|ray id|impressum|kontakt|startseite|suche|anmelden|datenschutz|accueil
        recherche|connexion|mentions légales|inicio|buscar|contacto|aviso legal|rss|faq|blog|news|tags|categories|feedback
        """,
}
#: Words of the usual Latin filler.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna"
    " aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis"
    " aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat"
    " non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Words of made-up rows.
DUMMY = set("foo bar baz qux quux title test item sample example dummy heading subheading section paragraph text entry blah".split())
#: Names of fields that templates fill in.
FIELD = (
    r"(?:title|headline|name|first[ _.]?name|last[ _.]?name|user(?:[ _.]?name)?|author|post|page|item|site|video|url|link|id|date"
    r"|time|year|month|day|topic|subject|summary|description|desc|company|organi[sz]ation|product|repo|repository|speaker"
    r"|duration|price|amount|version|category|tag|email|e-mail|phone|address|city|country|recipient|customer|client|image"
    r"|text|content|body|message|number|count|quantity|order|project|team|event|location|city|channel|episode|host|guest"
    r"|label|value|key|field|variable|placeholder|here|article|section|chapter|publisher|source|domain)"
)
_WORDS = rf"{FIELD}(?:[ _.]{FIELD})*"
PLACEHOLDER = regex.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\{%[^{}\n]{0,60}%\}|<%[^<>\n]{0,60}%>|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|%\([A-Za-z_.]{1,40}\)[sdif]"
    r"|(?<!\w)%[A-Z][A-Z_]{2,40}%|(?<!\w)__[A-Z][A-Z_]{2,40}__(?!\w)|@@[a-z_. ]{2,40}@@|\[\[[A-Z][A-Z_]{2,40}\]\]|\[object Object\]"
    r"|(?<!\w)XXX+(?!\w)|\[(?i:insert|enter|add|your)[ _][^\[\]\n]{1,40}\](?!\()"
    rf"|(?<![\w$])\{{(?i:{_WORDS})\}}|<(?i:{_WORDS})>|«(?i:{_WORDS})»|(?<!\w)\$(?i:{_WORDS})(?<=[A-Z])(?!\w)"
    rf"|\[(?:(?=[A-Z_. ]+\])(?i:{_WORDS}))\](?!\()|(?<!\w)(?:TODO|FIXME|TBD): ?(?i:{_WORDS})(?!\w)"
)
#: How placeholders begin; PLACEHOLDER decides from there on.
OPENERS = "{{|{%|<%|${|#{|%(|%|__|@@|[[|[object object]|xxx|[|{|<|«|$|todo:|fixme:|tbd:".split("|")
CODE = regex.compile(r"(?s)```.*?(?:```|$)|~~~.*?(?:~~~|$)|``[^\n]+?``|`[^`\n]*`|<code\b.*?</code>|<pre\b.*?</pre>")
TAG = regex.compile(r"(?s)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)>|</?[a-zA-Z!][^<>]*>")
SENTENCE = regex.compile(r"(?<=[.!?…])[\"”')\]]*\s+|(?<=[。！？])|\s*[\n\r|•·]+\s*|\s+[—–»›]\s+|\",\s*\"")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}']+")
#: Keys of one row of a keyboard, struck at random: no list of phrases can hold them.
MASH = regex.compile(r"(?<!\w)[asdfghjkl]{4,}(?!\w)")
MASHED = regex.compile(r"[asdfghjkl]+")
#: Traces that servers add to their error pages.
TRACE = regex.compile(
    r"(?<!\w)(?:request id|request|reference|incident|ray id|ray|session|trace id|error id|event id|ref|code)[:# ]+"
    r"(?:(?=[a-z-]*\d)[a-z0-9-]{4,40}|[a-z0-9]{6})(?![\w-])|(?<!\w)[a-z]+/\d+(?:\.\d+)*(?!\w)"
)
#: A document is residue from this share of its text on, and a sentence from this share of its letters.
COVERAGE, SENTENCE_COVERAGE = 0.6, 0.5
#: Shares of a sentence's words that make it filler: words of Latin filler, words of made-up rows.
LATIN_SHARE, DUMMY_SHARE = 0.8, 1.0

RESULT = "struct<reason:string,coverage:double>"
_ready: list = []
_openers: list = []


def _automaton() -> ahocorasick.Automaton:
    """Phrases, and the words of filler, each with its kind."""
    if not _ready:
        a = ahocorasick.Automaton()
        words = {"latin": LATIN, "dummy": DUMMY, "status": {str(n) for n in range(400, 600)}}
        found: dict[str, list[str]] = {}
        for kind, text in PHRASES.items():
            for phrase in filter(None, (p.strip() for line in text.splitlines() for p in line.split("|"))):
                found[phrase] = [kind]  # of equal phrases the last kind counts
        for kind, some in words.items():
            for word in some:
                found.setdefault(word, []).append(kind)
        for phrase, kinds in found.items():
            a.add_word(phrase, (tuple(kinds), len(phrase)))
        a.make_automaton()
        _ready.append(a)
    return _ready[0]


def _opening() -> ahocorasick.Automaton:
    if not _openers:
        a = ahocorasick.Automaton()
        for mark in OPENERS:
            a.add_word(mark, len(mark))
        a.make_automaton()
        _openers.append(a)
    return _openers[0]


def placeholder(text: str) -> bool:
    """Whether a placeholder stands in the text outside code."""
    marked = "`" in text or "~~~" in text or "<code" in text or "<pre" in text
    prose = CODE.sub(" ", text) if marked else text
    # as long as the text, which lower() may not keep
    small = prose.lower() if prose.isascii() else "".join(c if len(c.lower()) != 1 else c.lower() for c in prose)
    for last, size in _opening().iter(small):
        found = PLACEHOLDER.match(prose, last + 1 - size)
        if found:
            tag = found.group(0)
            if not (tag[0] == "<" and tag[1] != "%" and f"</{tag[1:]}" in text):
                return True
    return False


def _whole(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] ends at word borders (scripts without spaces have none)."""
    inner = lambda i: 0 <= i < len(text) and text[i].isalnum() and text[i] < "⺀"
    return not (inner(start - 1) and inner(start)) and not (inner(end - 1) and inner(end))


def matches(text: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, kinds) of what the automaton finds at word borders."""
    return [
        (last + 1 - size, last + 1, kinds) for last, (kinds, size) in _automaton().iter(text) if _whole(text, last + 1 - size, last + 1)
    ]


def _suspicious(text: str) -> bool:
    """Whether any sentence of the text can be residue: a phrase is in it, or words of filler stand side by side or
    begin a sentence.  Most proper texts end here."""
    after = -9
    for start, end, kinds in matches(text):
        for kind in kinds:
            if kind in ("error_page", "script_notice", "filler"):
                return True
            if kind == "latin":
                if start - after <= 3:
                    return True
                after = end
            if kind in ("dummy", "status"):
                lead = text[max(0, start - 24):start].rstrip(" \t#>*-_={}[]:,\"'()0123456789")
                if not lead or not lead[-1].isalnum():
                    return True
    return MASH.search(text) is not None


def judge_sentence(sentence: str) -> tuple[str, float]:
    """What a sentence is (a kind of PHRASES, or text), and the share of it that patterns cover."""
    sentence = TRACE.sub(" ", sentence).strip()
    words = WORD.findall(sentence)
    if not words:
        return "chrome", 1.0
    found = matches(sentence)
    spelled = [w for w in words if not w.isdigit()]
    count = lambda kind: sum(kind in kinds for _, _, kinds in found)
    if len(words) >= 2 and count("latin") >= LATIN_SHARE * len(words):
        return "filler", 1.0
    if len(words) >= 2 and all(MASHED.fullmatch(w) for w in words) and max(map(len, words)) >= 4:
        return "filler", 1.0
    if spelled and count("dummy") >= DUMMY_SHARE * len(spelled):
        return "filler", 1.0
    if count("status") == 1 and [w for w in words if w != "error"] == [w for w in words if w.isdigit()] and len(words) <= 2:
        return "error_page", 1.0
    if not spelled:
        return "chrome", 1.0
    covered, by = bytearray(len(sentence)), {}
    for start, end, kinds in found:
        if kinds[0] in PHRASES:
            covered[start:end] = b"\1" * (end - start)
            by[kinds[0]] = by.get(kinds[0], 0) + end - start
    letters = sum(c.isalnum() for c in sentence)
    share = sum(c.isalnum() and covered[i] for i, c in enumerate(sentence)) / letters
    hits = {k: v for k, v in by.items() if k != "chrome"}
    kind = max(hits, key=hits.get) if hits else "chrome" if by else "text"
    return kind, share


def judge(text: str) -> tuple[str | None, float]:
    """(reason, coverage) of one text; reason None if it is proper content."""
    if placeholder(text):
        return "placeholder", 1.0
    marked = "`" in text or "~~~" in text or "<code" in text or "<pre" in text
    prose = CODE.sub(" ", text) if marked else text
    plain = TAG.sub("\n", prose) if "<" in prose else prose
    plain = html.unescape(plain) if "&" in plain else plain
    plain = plain if plain.isascii() else unicodedata.normalize("NFKC", plain).replace("’", "'")
    plain = plain.casefold()
    if not _suspicious(plain):
        return None, 0.0
    lines = [x for x in (s.strip(" \t#>*-_={}[]:,\"") for s in SENTENCE.split(plain)) if x]
    sums = dict.fromkeys(PHRASES, 0) | {"text": 0}
    for at, line in enumerate(lines):
        kind, share = judge_sentence(line)
        if kind in ("error_page", "script_notice", "filler") and share < SENTENCE_COVERAGE:
            # patterns inside a longer sentence cover only themselves
            sums[kind] += share * len(line)
            sums["text"] += (1 - share) * len(line)
            continue
        if kind == "chrome" and share < 0.7:
            kind = "text"
        title = at == 0 and len(lines) > 1 and len(line) <= 120 and line[-1:] not in ".!?。"
        if kind == "text" and title:
            continue
        sums[kind] += len(line)
    found = sums["error_page"] + sums["script_notice"] + sums["filler"]
    if not found:
        return None, 0.0
    coverage = found / (found + sums["text"])
    if coverage < COVERAGE:
        return None, coverage
    return max(("error_page", "script_notice", "filler"), key=lambda k: sums[k]), coverage


def residue(text: Column) -> Column:
    """Struct (reason, coverage); reason is null for proper content and for null or empty text."""

    @task_udf(RESULT)
    def judged(texts: pa.Array) -> pa.Array:
        seen: dict[str, tuple] = {}  # equal texts in a batch are judged once
        reasons, shares = [], []
        for t in texts.to_pylist():
            if t is None or not t.strip():
                r = (None, 0.0)
            elif t in seen:
                r = seen[t]
            else:
                r = seen[t] = judge(t)
            reasons.append(r[0])
            shares.append(r[1])
        return pa.StructArray.from_arrays([pa.array(reasons, pa.string()), pa.array(shares, pa.float64())], ["reason", "coverage"])

    # else a filter on the result would move the judging below the repartition that spreads it
    return judged.asNondeterministic()(text)
