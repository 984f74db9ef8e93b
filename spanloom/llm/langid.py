"""Language of every document and of every segment of a mixed one, by a byte convolutional network.

Training (numpy, on the driver): bytes are embedded, filters of several widths slide over fixed-length windows, each
filter keeps its largest response, and a softmax over the responses gives the language. It is fitted on labelled text
(``lang_samples`` and the short everyday sentences below, then labelled documents whose label a first fit confirms;
the numbers of rows are bounded by parameters of :func:`fit`, bounds that only concern the fit), with accents varied.
The fitted arrays are about 60 kB and are broadcast.

Application: a text is cut into sentences of prose (code blocks, SQL, log lines, key=value lines, identifiers, tables
and CITED lines are not prose); every sentence is scored in fixed-length windows, all windows of a batch in one matrix
product; within a document a chain over the sentences weighs each score against its neighbours', so a short sentence
follows its surroundings unless it clearly differs. Sentences of one language in a row form a segment.

Defined results: null, empty and blank texts and texts without prose give no segment; confidence is the mean
probability of the segment's language; other columns are ignored. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The languages, and the names they go by besides their two-letter code.
LANGS = ("en", "de", "fr", "es", "pt", "it", "nl", "sv", "pl", "ru", "ja")
NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castilian",
    "pt": "por portuguese português portugues", "it": "ita italian italiano", "nl": "nld dut dutch nederlands flemish", "sv": "swe swedish svenska",
    "pl": "pol polish polski", "ru": "rus russian русский", "ja": "jpn japanese 日本語",
}
#: What a label says when it says nothing.
NO_LABEL = ("", "??", "?", "-", "n/a", "na", "und", "unknown", "none", "null", "mul", "zxx", "mis", "other", "xx")

#: Everyday sentences, labelled text besides the samples (plain general language, not taken from any table).
EVERYDAY = {
    "en": "Where is the key? I do not know what to say. She was here this morning. We have to go now, please wait a little. They are not at home. It is very cold today. How much does that cost? You can ask me again later. There is nothing left. What would you do with these? He said that he had seen it before. Good, let us try once more. This is my brother and those are his friends. I think so too. There are many people in the street, and none of them looks at us. Could we talk about that tomorrow? No, this is not mine. Nothing new today. Look at the picture on the left. Who has been there for two years? I hope they will come back soon. You should not do it without me. The old house stands behind the church. Both of my sisters live in a small town. Once more from the start.",
    "de": "Wo ist der Schlüssel? Ich weiß nicht, was ich sagen soll. Sie war heute Morgen hier. Wir müssen jetzt gehen, bitte warte ein wenig. Sie sind nicht zu Hause. Es ist sehr kalt heute. Wie viel kostet das? Du kannst mich später wieder fragen. Es ist nichts mehr übrig. Was würdest du damit machen? Er sagte, dass er es schon gesehen hatte. Gut, versuchen wir es noch mal. Das ist mein Bruder und das sind seine Freunde. Das glaube ich auch. Könnt ihr mir helfen? Hier oben, dort unten. Es gibt viele Leute auf der Straße, und keiner von ihnen sieht uns an. Könnten wir morgen darüber reden? Nein, das gehört mir nicht. Heute nichts Neues. Sieh dir das Bild links an. Wer ist seit zwei Jahren dort? Ich hoffe, sie kommen bald zurück. Du solltest es nicht ohne mich tun. Das alte Haus steht hinter der Kirche. Meine beiden Schwestern wohnen in einer kleinen Stadt. Noch einmal von vorn. Wurde wegen des Wetters nicht gearbeitet? Sie hätte lieber gewartet.",
    "fr": "Où est la clé ? Je ne sais pas quoi dire. Elle était ici ce matin. Nous devons partir maintenant, attends un peu s'il te plaît. Ils ne sont pas à la maison. Il fait très froid aujourd'hui. Combien ça coûte ? Tu peux me demander plus tard. Il ne reste rien. Qu'est-ce que tu ferais avec cela ? Il a dit qu'il l'avait déjà vu. Bon, essayons encore. C'est mon frère et ce sont ses amis. Je le pense aussi. Pouvez-vous m'aider ? En haut, en bas, avec nous. Il y a beaucoup de gens dans la rue, et aucun d'eux ne nous regarde. Pourrions-nous en parler demain ? Non, ce n'est pas à moi. Rien de nouveau aujourd'hui. Regarde l'image à gauche. Qui est là depuis deux ans ? J'espère qu'ils vont bientôt revenir. Tu ne devrais pas le faire sans moi. La vieille maison se trouve derrière l'église. Mes deux sœurs habitent dans une petite ville. Encore une fois depuis le début. Aucune raison, pas encore, mieux vaut attendre.",
    "es": "¿Dónde está la llave? No sé qué decir. Ella estaba aquí esta mañana. Tenemos que irnos ahora, espera un poco por favor. Ellos no están en casa. Hoy hace mucho frío. ¿Cuánto cuesta eso? Puedes preguntarme más tarde. No queda nada. ¿Qué harías tú con esto? Él dijo que ya lo había visto. Bueno, vamos a probar una vez más. Este es mi hermano y estos son sus amigos. Yo también lo creo. ¿Me podéis ayudar? Arriba, abajo, con nosotros. Muy bien, hasta luego. Hay mucha gente en la calle y ninguno de ellos nos mira. ¿Podríamos hablar de eso mañana? No, esto no es mío. Nada nuevo hoy. Mira el dibujo de la izquierda. ¿Quién está allí desde hace dos años? Espero que vuelvan pronto. No deberías hacerlo sin mí. La casa vieja está detrás de la iglesia. Mis dos hermanas viven en una ciudad pequeña. Otra vez desde el principio. El hijo del vecino se sienta en medio de la plaza. Al final se va con el perro y lo deja en el jardín. Ninguna razón, todavía no, mejor esperar.",
    "pt": "Onde está a chave? Não sei o que dizer. Ela estava aqui esta manhã. Temos que ir agora, espera um pouco por favor. Eles não estão em casa. Hoje está muito frio. Quanto custa isso? Você pode me perguntar mais tarde. Não sobrou nada. O que você faria com isto? Ele disse que já tinha visto. Bom, vamos tentar mais uma vez. Este é o meu irmão e estes são os seus amigos. Eu também acho. Vocês podem me ajudar? Em cima, embaixo, conosco. Muito bem, até logo. Há muita gente na rua e nenhum deles olha para nós. Podemos falar sobre isso amanhã? Não, isto não é meu. Nada de novo hoje. Olha a imagem à esquerda. Quem está lá há dois anos? Espero que voltem logo. Você não deveria fazer isso sem mim. A casa velha fica atrás da igreja. As minhas duas irmãs moram numa cidade pequena. Outra vez desde o começo. O filho do vizinho senta-se no meio da praça. No fim ele vai embora com o cão e deixa a bola no jardim. Nenhuma razão, ainda não, é melhor esperar. Um livro só, que faz parte dela.",
    "it": "Dov'è la chiave? Non so che cosa dire. Lei era qui stamattina. Dobbiamo andare adesso, aspetta un po' per favore. Loro non sono a casa. Oggi fa molto freddo. Quanto costa questo? Puoi chiedermelo più tardi. Non è rimasto niente. Che cosa faresti tu con questi? Lui ha detto che lo aveva già visto. Bene, proviamo un'altra volta. Questo è mio fratello e questi sono i suoi amici. Lo penso anche io. Potete aiutarmi? Sopra, sotto, con noi. Va bene, a dopo. C'è molta gente per strada e nessuno di loro ci guarda. Potremmo parlarne domani? No, questo non è mio. Niente di nuovo oggi. Guarda il disegno a sinistra. Chi è lì da due anni? Spero che tornino presto. Non dovresti farlo senza di me. La vecchia casa si trova dietro la chiesa. Le mie due sorelle abitano in una piccola città. Un'altra volta dall'inizio. Il figlio del vicino si siede in mezzo alla piazza. Alla fine se ne va con il cane e lo lascia nel giardino. Nessuna ragione, non ancora, è meglio aspettare.",
    "nl": "Waar is de sleutel? Ik weet niet wat ik moet zeggen. Ze was hier vanmorgen. We moeten nu gaan, wacht even alsjeblieft. Zij zijn niet thuis. Het is erg koud vandaag. Hoeveel kost dat? Je kunt het me later nog vragen. Er is niets meer over. Wat zou jij daarmee doen? Hij zei dat hij het al had gezien. Goed, laten we het nog eens proberen. Dit is mijn broer en dat zijn zijn vrienden. Dat denk ik ook. Kunnen jullie mij helpen? Hierboven, daar beneden, met ons. Graag gedaan, tot straks. Er zijn veel mensen op straat en niemand van hen kijkt naar ons. Zouden we daar morgen over kunnen praten? Nee, dit is niet van mij. Vandaag niets nieuws. Kijk naar de tekening links. Wie is daar al twee jaar? Ik hoop dat ze gauw terugkomen. Je zou het niet zonder mij moeten doen. Het oude huis staat achter de kerk. Mijn twee zussen wonen in een kleine stad. Nog een keer vanaf het begin. Geen reden, nog niet, het is beter om te wachten. Een zoon van de buurman zit midden op het plein. Gisteren was het mooier, sinds vorige week.",
    "sv": "Var är nyckeln? Jag vet inte vad jag ska säga. Hon var här i morse. Vi måste gå nu, vänta lite är du snäll. De är inte hemma. Det är mycket kallt i dag. Hur mycket kostar det där? Du kan fråga mig senare. Det finns inget kvar. Vad skulle du göra med de här? Han sade att han redan hade sett det. Bra, låt oss försöka igen. Det här är min bror och det där är hans vänner. Det tror jag också. Kan ni hjälpa mig? Här uppe, där nere, med oss. Varsågod, vi ses sedan. Det finns många människor på gatan och ingen av dem ser på oss. Skulle vi kunna prata om det i morgon? Nej, den är inte min. Inget nytt i dag. Titta på bilden till vänster. Vem har varit där i två år? Jag hoppas att de kommer tillbaka snart. Du borde inte göra det utan mig. Det gamla huset ligger bakom kyrkan. Mina två systrar bor i en liten stad. En gång till från början. Ingen anledning, inte än, det är bättre att vänta. Grannens son sitter mitt på torget.",
    "pl": "Gdzie jest klucz? Nie wiem, co powiedzieć. Ona była tu dziś rano. Musimy już iść, poczekaj trochę proszę. Nie ma ich w domu. Dzisiaj jest bardzo zimno. Ile to kosztuje? Możesz mnie zapytać później. Nic nie zostało. Co byś z tym zrobił? Powiedział, że już to widział. Dobrze, spróbujmy jeszcze raz. To jest mój brat, a to są jego przyjaciele. Ja też tak myślę. Czy możecie mi pomóc? Na górze, na dole, z nami. Bardzo dobrze, do zobaczenia. Na ulicy jest wielu ludzi i nikt z nich na nas nie patrzy. Czy moglibyśmy o tym porozmawiać jutro? Nie, to nie jest moje. Dzisiaj nic nowego. Popatrz na obrazek po lewej. Kto jest tam od dwóch lat? Mam nadzieję, że niedługo wrócą. Nie powinieneś tego robić beze mnie. Stary dom stoi za kościołem. Moje dwie siostry mieszkają w małym mieście. Jeszcze raz od początku. Bez powodu, jeszcze nie, lepiej zaczekać.",
    "ru": "Где ключ? Я не знаю, что сказать. Она была здесь утром. Нам пора идти, подожди немного. Их нет дома. Сегодня очень холодно. Сколько это стоит? Ты можешь спросить меня позже. Ничего не осталось. Он сказал, что уже видел это. Хорошо, попробуем ещё раз. На улице много людей, и никто из них на нас не смотрит. Мы могли бы поговорить об этом завтра? Нет, это не моё. Сегодня ничего нового. Посмотри на рисунок слева. Надеюсь, они скоро вернутся.",
    "ja": "鍵はどこですか。何と言えばいいか分かりません。彼女は今朝ここにいました。もう行かなければなりません。今日はとても寒いです。いくらですか。後で聞いてください。何も残っていない。彼はもう見たと言った。通りには人がたくさんいる。明日それについて話せますか。いいえ、私のではありません。今日は新しいことはない。左の絵を見てください。彼らがすぐに戻るといい。",
}

WINDOW, WIDTHS, FILTERS, EMBED = 64, (2, 3, 4, 5), 40, 12
STAY = 0.65  # chance that a sentence is in the language of the one before it

# --- text -----------------------------------------------------------------------------------------------------------

_DROP = re.compile("[​-‏﻿⁠️]")
_FENCE = re.compile(r"^\W*(?:\[\d\d:\d\d\]\s*)?(?:[-*•>]\s*)?```")
_MARK = re.compile(r"^\s*(?:(?:\[\d{1,2}:\d\d\]|[-*•>#–—]+|\d{1,3}[.)])\s+)*")
_CITED = re.compile(r"^\W*cited\W*:", re.I)
_SQL = re.compile(r"^\W*(?:with\s+\w+\s+as\s*\(|select\b.*\bfrom\b|select\b.*[(*,]|insert\s+into\b|update\s+\w+\s+set\b|delete\s+from\b|create\s+(?:table|view|index)\b|drop\s+|alter\s+|from\s+\w+\s*(?:$|where|group|join|;)|where\s+\S+\s*(?:[<>=!]|in\b|between\b)|group\s+by\b|order\s+by\s+\S+(?:\s*,|\s*$|\s+desc|\s+asc|;)|limit\s+\d+|and\s+\S+\s*[<>=]|(?:left|inner|right)?\s*join\s+\w+\s+(?:on|\w+\s+on)\b|union\s+all\b)", re.I | re.S)
_LOG = re.compile(r"^\W*(?:(?:\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d\S*)|(?:LOG|ERROR|FATAL|PANIC|WARNING|NOTICE|DEBUG\d?|INFO|DETAIL|HINT|STATEMENT|CONTEXT):\s|Traceback \(|File \"|at [\w.$]+\()")
_KEY = re.compile(r"[\w.-]+")
_END = re.compile(r"(?<=[.!?…])[\"'»”’)*_]*\s+|(?<=[。！？])[」』”）]*\s*")
_RUN = re.compile(r"[A-Za-z0-9_./=\\@-]+")
_TICKS = re.compile(r"`[^`]*`")
_CJK = re.compile("[぀-ヿ一-鿿]")


_FIRST = re.compile(r"\W*(\w+)")
_SQL_FIRST = frozenset("with select insert update delete create drop alter from where group order limit and left inner right join union".split())
_LOG_FIRST = frozenset("log error fatal panic warning notice debug debug1 debug2 debug3 debug4 debug5 info detail hint statement context traceback file at".split())
_ODD = re.compile(r"[0-9_=/\\@`]")
_WORD = re.compile(r"[^\W\d_]+")
_ALNUM = re.compile(r"[^\W_]")
_SIGNS = re.compile(r"[0-9*#|~^<>{}\[\]\"“”„«»()=+]+")


def _pairs(line: str) -> bool:
    """Whether every word of a line is key=value."""
    some = False
    for t in line.split():
        key, sign, _ = t.partition("=")
        if not _ALNUM.search(t):
            continue
        if not sign or not _KEY.fullmatch(key.strip("`*_-•>[]()\"'")):
            return False
        some = True
    return some


def _plain(word: str) -> str:
    """A word without identifiers: runs of ASCII with digits, underscores or path signs."""
    return _RUN.sub(lambda m: " " if _ODD.search(m.group()) else m.group(), word)


def _wordy(t: str) -> bool:
    """Whether a sentence has three words, or five characters of a script without blanks. Stops as soon as it has."""
    n = 0
    for _ in _WORD.finditer(t):
        n += 1
        if n == 3:
            return True
    return not t.isascii() and len(_CJK.findall(t)) >= 5


def _is_prose(line: str) -> bool:
    """Whether a line without its marks is prose; the patterns are tried only where the first word or a sign calls for it."""
    m = _FIRST.match(line)
    first = m[1].lower() if m else ""
    if first == "cited" and _CITED.match(line):
        return False
    if first in _SQL_FIRST and _SQL.match(line):
        return False
    if (first in _LOG_FIRST or first[:1].isdigit()) and _LOG.match(line):
        return False
    if "=" in line and _pairs(line) or line.lstrip()[:1] in "{|<":
        return False
    return not (line.count(",") >= 3 and len(line.split()) == 1 and line.isascii())


def sentences(text: str) -> list[str]:
    """Sentences of prose of a text, as they are scored: composed characters, lower case, identifiers left out."""
    out: list[str] = []
    fenced = False
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFC", text))
    for line in re.split("[\r\n\u2028\u2029]+", text):
        if "```" in line and _FENCE.match(line):
            if line.count("```") % 2:
                fenced = not fenced
            continue
        if fenced or not line.strip():
            continue
        line = _MARK.sub("", line, count=1)
        if not _is_prose(line):
            continue
        for s in _END.split(line):
            if not s:
                continue
            if _ODD.search(s):
                if "=" in s and _pairs(s):
                    continue
                s = " ".join([_plain(w) if _ODD.search(w) else w for w in (_TICKS.sub(" ", s) if "`" in s else s).split()])
            m = _FIRST.match(s)
            if m and m[1].lower() == "cited" and _CITED.match(s):
                continue
            t = " ".join(_SIGNS.sub(" ", s).lower().split())
            if _wordy(t):
                out.append(t)
    return out


def label_of(raw: str | None) -> str | None:
    """Two-letter code of a label; None where it says nothing; other codes as they stand."""
    if raw is None:
        return None
    t = raw.strip().lower()
    if t in NO_LABEL:
        return None
    base = re.split(r"[-_ ]", t, maxsplit=1)[0]
    for code, names in NAMES.items():
        if base == code or t in names.split() or base in names.split():
            return code
    return base


def label_column(c: Column) -> Column:
    """The same as :func:`label_of`, in the JVM."""
    t = F.lower(F.trim(c))
    base = F.element_at(F.split(t, "[-_ ]"), 1)
    known = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in [code, *names.split()] for x in (n, code)])
    return F.when(c.isNull() | t.isin(*NO_LABEL), F.lit(None).cast("string")).otherwise(F.coalesce(F.try_element_at(known, t), F.try_element_at(known, base), base))


# --- network --------------------------------------------------------------------------------------------------------

def windows(text: str) -> np.ndarray:
    """Fixed-length byte windows over all of a sentence; the last one is aligned to its end."""
    raw = np.frombuffer((" " + text + " ").encode("utf-8", "replace"), np.uint8)
    if len(raw) <= WINDOW:
        return np.concatenate([raw, np.full(WINDOW - len(raw), 32, np.uint8)])[None, :]
    at = list(range(0, len(raw) - WINDOW, WINDOW)) + [len(raw) - WINDOW]
    return np.stack([raw[i : i + WINDOW] for i in at])


def forward(m: dict[str, np.ndarray], x: np.ndarray, drop: np.ndarray | None = None) -> tuple[np.ndarray, list]:
    """Log-probabilities of windows (n, WINDOW); what the backward pass needs."""
    e = m["embed"][x]
    pooled, kept = [], []
    for w in WIDTHS:
        cols = sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(-1, w * EMBED)
        z = (cols @ m[f"w{w}"]).reshape(len(x), WINDOW - w + 1, FILTERS)
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None, :], 1)[:, 0, :] + m[f"b{w}"]
        pooled.append(np.maximum(top, 0))
        kept.append((w, cols, at, top))
    h = np.concatenate(pooled, axis=1)
    if drop is not None:
        h = h * drop
    z = h @ m["out"] + m["bias"]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), [e, h, kept]


def gradients(m: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, drop: np.ndarray, bytes_too: bool = True) -> dict[str, np.ndarray]:
    """drop: the factor of each pooled response (0 where it is left out); bytes_too: also for the bytes' embedding."""
    lp, (e, h, kept) = forward(m, x, drop)
    d = np.exp(lp)
    d[np.arange(len(x)), y] -= 1
    d /= len(x)
    g = {"out": h.T @ d, "bias": d.sum(axis=0), "embed": np.zeros_like(m["embed"])}
    dh = (d @ m["out"].T) * drop
    for i, (w, cols, at, top) in enumerate(kept):
        dt = dh[:, i * FILTERS : (i + 1) * FILTERS] * (top > 0)
        g[f"b{w}"] = dt.sum(axis=0)
        rows = at + (np.arange(len(x)) * (WINDOW - w + 1))[:, None]
        g[f"w{w}"] = np.einsum("nfk,nf->kf", cols[rows], dt, optimize=True)
        if not bytes_too:
            continue
        back = dt[:, :, None] * m[f"w{w}"].T[None]  # (n, filters, w * EMBED)
        pos = at[:, :, None] + np.arange(w)
        cell = x[np.arange(len(x))[:, None, None], pos].astype(np.int64)[..., None] * EMBED + np.arange(EMBED)
        g["embed"] += np.bincount(cell.ravel(), weights=back.ravel(), minlength=256 * EMBED).reshape(256, EMBED).astype(np.float32)
    return g


def made_up(rng: np.random.Generator) -> str:
    """A word of no language, as names of tables and projects are."""
    a, b = "bcdfghklmnprstvwxz", "aeiou"
    n = rng.integers(0, 16, 8)
    return "".join(a[i % len(a)] + b[j % 5] + (a[(i + j) % len(a)] if j > 11 else "") for i, j in zip(n[:4], n[4:]))[: 3 + int(n[0]) // 2 + int(n[1]) % 3]


def bare(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def train(
    texts: list[str], labels: list[str], start: dict[str, np.ndarray] | None = None, more: list[tuple[str, int]] = (),
    steps: int = 700, batch: int = 64, seed: int = 5, rate: float = 4e-3,
) -> dict[str, np.ndarray]:
    """Fit the network on labelled texts with Adam; a part of the sentences is cut, stripped of accents, or given a made-up word.

    start: arrays to go on from, the bytes' embedding as it is; more: further sentences with the position of their language.
    """
    rng = np.random.default_rng(seed)
    pool: dict[int, list[str]] = {i: [] for i in range(len(LANGS))}
    everyday: dict[int, list[str]] = {i: sentences(EVERYDAY[c].replace(". ", ".\n").replace("? ", "?\n").replace("。", "。\n")) for i, c in enumerate(LANGS)}
    for t, c in zip(texts, labels):
        if c in LANGS and t:
            pool[LANGS.index(c)] += sentences(t)
    extra: dict[int, list[str]] = {i: [] for i in range(len(LANGS))}
    for t, i in more:
        extra[i].append(t)
    pool = {i: (p or everyday[i]) for i, p in pool.items()}
    m = start or {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(LANGS))), "bias": np.zeros(len(LANGS))}
    for w in WIDTHS if start is None else ():
        m[f"w{w}"], m[f"b{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)), np.zeros(FILTERS)
    m = {k: v.astype(np.float32) for k, v in m.items()}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, len(LANGS), batch)
        rows = []
        for i in y:
            u = rng.random()
            src = extra[i] if u < 0.5 and extra[i] else everyday[i] if u < 0.7 else pool[i]
            t = src[rng.integers(len(src))]
            if rng.random() < 0.4:  # a run of words from anywhere in the sentence
                words = t.split(" ") if i != len(LANGS) - 1 else list(t)
                a = rng.integers(len(words))
                t = (" " if i != len(LANGS) - 1 else "").join(words[a : a + rng.integers(3, 9)])
            if rng.random() < 0.4 and i != len(LANGS) - 1:
                words = t.split(" ")
                words.insert(rng.integers(len(words) + 1), made_up(rng))
                t = " ".join(words)
            if rng.random() < 0.4:
                t = bare(t)
            ws = windows(t)
            rows.append(ws[rng.integers(len(ws))])
        g = gradients(m, np.stack(rows), y, (rng.random((batch, len(WIDTHS) * FILTERS)) > 0.3).astype(np.float32) / np.float32(0.7), start is None)
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in m:
            gk = g[k].astype(np.float32)
            first[k] += 0.1 * (gk - first[k])
            second[k] += 0.01 * (gk * gk - second[k])
            m[k] -= (lr * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6) + 1e-4 * m[k])).astype(np.float32)
    return m


def agreeing(m: dict[str, np.ndarray], docs: list[tuple[str, str]]) -> list[tuple[str, int]]:
    """Sentences of labelled documents whose label the network confirms for the document as a whole.

    Labels are often wrong and some texts are mixed: a document counts only where the label's language leads by far over
    all its sentences, and a sentence only where no other language is clearly ahead.
    """
    scorer, out = Scorer(m), []
    for text, label in docs:
        ss = sentences(text)
        if label not in LANGS or not ss:
            continue
        i, lp = LANGS.index(label), np.stack(list(map(scorer.scores(ss).get, ss)))
        lead = lp.argmax(axis=1) == i
        if lead.mean() >= 0.7:
            out += [(s, i) for s, row in zip(ss, lp) if row.max() - row[i] < 3.0]
    return out


_fitted: dict[tuple, dict[str, np.ndarray]] = {}


def fit(
    samples: DataFrame, documents: DataFrame | None = None, text: str = "text", lang: str = "lang",
    max_samples: int = 5000, max_documents: int = 2500, max_chars: int = 4000,
) -> dict[str, np.ndarray]:
    """A network fitted on at most ``max_samples`` labelled rows, then on at most ``max_documents`` labelled documents.

    The bounds concern the fit only. Documents are taken in the order of a hash, those of up to ``max_chars``
    characters; a first network decides which of their labels to believe (:func:`agreeing`). Equal rows give the same
    arrays, and the fit is kept for them.
    """
    def take(df: DataFrame, n: int) -> list[tuple[str, str]]:
        ok = df.select(F.col(text).alias("t"), label_column(F.col(lang)).alias("l")).where(F.col("l").isin(*LANGS) & F.col("t").isNotNull() & (F.length("t") <= max_chars))
        return [(r["t"], r["l"]) for r in ok.orderBy(F.xxhash64("t"), "t", "l").limit(n).collect()]

    rows = take(samples, max_samples)
    docs = take(documents, max_documents) if documents is not None else []
    key = (hash(tuple(rows)), hash(tuple(docs)))
    if key not in _fitted:
        t, c = [x for x, _ in rows], [x for _, x in rows]
        m = train(t, c)
        _fitted[key] = train(t, c, start=m, more=agreeing(m, docs), steps=900, rate=2e-3) if docs else m
    return _fitted[key]


class Scorer:
    """Scores sentences; keeps the scores of sentences it has met, up to a bound.

    All filters are laid side by side in one matrix, so a batch is one product; batches are small enough for the cache.
    """

    def __init__(self, m: dict[str, np.ndarray], keep: int = 100_000, batch: int = 32) -> None:
        self.m, self.keep, self.batch, self.known = m, keep, batch, {}
        self.wide = max(WIDTHS)
        self.filters = np.zeros((self.wide * EMBED, len(WIDTHS) * FILTERS), np.float32)
        for i, w in enumerate(WIDTHS):
            self.filters[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = m[f"w{w}"]
        self.shift = np.concatenate([m[f"b{w}"] for w in WIDTHS])

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows, as :func:`forward` gives them."""
        e = self.m["embed"][np.concatenate([x, np.zeros((len(x), self.wide - 1), np.uint8)], axis=1)]
        cols = np.empty((len(x), WINDOW, self.wide * EMBED), np.float32)
        for o in range(self.wide):
            cols[:, :, o * EMBED : (o + 1) * EMBED] = e[:, o : o + WINDOW]
        z = (cols.reshape(-1, self.wide * EMBED) @ self.filters).reshape(len(x), WINDOW, -1)
        top = np.concatenate([z[:, : WINDOW - w + 1, i * FILTERS : (i + 1) * FILTERS].max(axis=1) for i, w in enumerate(WIDTHS)], axis=1)
        y = np.maximum(top + self.shift, 0) @ self.m["out"] + self.m["bias"]
        y -= y.max(axis=1, keepdims=True)
        return y - np.log(np.exp(y).sum(axis=1, keepdims=True))

    def scores(self, batch: list[str]) -> dict[str, np.ndarray]:
        if len(self.known) > self.keep:
            self.known.clear()
        new = [s for s in dict.fromkeys(batch) if s not in self.known]
        ws = [windows(s) for s in new]
        if ws:
            x = np.concatenate(ws)
            lp = np.concatenate([self.windows(x[i : i + self.batch]) for i in range(0, len(x), self.batch)])
            for s, v in zip(new, np.add.reduceat(lp, np.cumsum([0, *(len(w) for w in ws[:-1])]), axis=0)):
                self.known[s] = v
        return {s: self.known[s] for s in set(batch)}


def smooth(lp: np.ndarray) -> np.ndarray:
    """Probabilities of each sentence's language given all sentences of the document (forward-backward over the chain)."""
    n, k = lp.shape
    p = np.exp(np.maximum(lp - lp.max(axis=1, keepdims=True), -20.0))
    move = np.full((k, k), (1 - STAY) / (k - 1))
    np.fill_diagonal(move, STAY)
    fwd, bwd = np.empty((n, k)), np.ones((n, k))
    a = np.full(k, 1 / k)
    for i in range(n):
        a = (a if i == 0 else a @ move) * p[i]
        a /= a.sum()
        fwd[i] = a
    for i in range(n - 2, -1, -1):
        b = move @ (bwd[i + 1] * p[i + 1])
        bwd[i] = b / b.sum()
    out = fwd * bwd
    return out / out.sum(axis=1, keepdims=True)


SEGMENTS = "doc_id long, segment int, lang string, confidence double, sentences int, chars int"


def segments(df: DataFrame, model: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", label: Column | None = None) -> DataFrame:
    """Segments of every document: ``doc_id, segment, lang, confidence, sentences, chars`` (chars of prose scored); with a label, ``label`` as well."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # about 60 kB

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                docs = [(i, sentences(t), l) for i, t, l in zip(part["k"], part["t"], part["l"]) if isinstance(t, str)]
                docs = [x for x in docs if x[1]]
                score = scorer.scores([s for _, ss, _ in docs for s in ss])
                out = []
                for i, ss, l in docs:
                    p = smooth(np.stack([score[s] for s in ss]).astype(float))
                    best = p.argmax(axis=1)
                    edges = [0, *(np.flatnonzero(np.diff(best)) + 1), len(ss)]
                    for n, (a, b) in enumerate(zip(edges, edges[1:])):
                        out.append((i, n, LANGS[best[a]], float(p[a:b, best[a]].mean()), int(b - a), sum(map(len, ss[a:b])), l))
                yield pd.DataFrame(out, columns=["doc_id", "segment", "lang", "confidence", "sentences", "chars", "label"])

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), (F.lit(None) if label is None else label).cast("string").alias("l")).where("t is not null and k is not null")
    out = rows.mapInPandas(go, SEGMENTS + ", label string")
    return out if label is not None else out.drop("label")


def languages(seg: DataFrame) -> DataFrame:
    """One row a document and language: ``doc_id, lang, confidence, sentences, share`` (share of the prose characters)."""
    per = seg.groupBy("doc_id", "lang").agg(
        (F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")).alias("confidence"), F.sum("sentences").alias("sentences"), F.sum("chars").alias("chars"))
    docs = per.groupBy("doc_id").agg(F.collect_list(F.struct("lang", "confidence", "sentences", "chars")).alias("x"), F.sum("chars").alias("all"))  # at most 11 a document
    return docs.select("doc_id", "all", F.explode("x").alias("x")).select("doc_id", "x.lang", "x.confidence", "x.sentences", (F.col("x.chars") / F.col("all")).alias("share"))
