"""Secret scan: a pattern finds candidates, a random forest tells secrets from look-alikes.

The forest is trained with pyspark.ml on labelled findings and then written out as a column expression over
arrays of candidates, so scanning and redacting are projections of each row: no join, no explode of texts. Each text
is cut into candidates and what is between them once, and put together again in one step, so work grows with the
text. The dictionary that candidates are held against is the corpus' own: words that many of its documents use.
"""

from __future__ import annotations

import random
import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that a credential is set to, in any case; key, auth and pass only as whole words.
NAMED = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|credentials?|authorization|(?<![a-z])(?:key|auth|pass))"
#: What stands between such a name and its value.
SET = r"[\"']?[ \t]{0,2}[=:][=>]?[ \t]{0,2}"
#: What stands before a value, tried first so that the long look-behind is met only behind an equals sign or colon.
_BEHIND = r"(?<=[=:> \t\"'])(?<=[=:][=>]?[ \t]{0,2}[\"']?)"
#: What stands before a password in a URL or behind an argument for one, and what says that one follows.
IN_URL, IN_ARGUMENT = r"://[^\s/:@\"']{1,40}:", r"\s-u[ \t]{1,2}[^\s:\"']{1,40}:"
TOLD = r"(?i:passw(?:or)?d|passphrase|passcode|pwd|secret|token|key) is "
#: An unquoted value's characters: those that can end it, those that can't, and any of them; & , and ; belong to it unless a next field or a space follows.
_ON = r"(?![A-Za-z_ ]{1,40}=)(?!\s)"
_BODY = rf"(?:[^\s\"'`&;,.:)\]}}>\\]++|&{_ON})"
_CLOSING = rf"(?:[.:)\]}}>\\]|[;,]{_ON})"
_ANY = rf"[^\s\"'`&;,]|[&;,]{_ON}"
#: A candidate: what a credential's name is set to, whole if quoted and else up to the next field or the end of the sentence;
#: a password in a URL, behind an argument or where a sentence tells it; the address of a hook; three to five dotted parts; or 16 or more token characters with a digit, with padding. Edges are open to full stops,
#: at signs, equals signs and colons: the forest judges by the context. Runs with alternatives are possessive, so that a value of
#: any length is matched without recursion.
CANDIDATE = (
    rf"{_BEHIND}(?:(?<={IN_URL})[^\s/@\"']{{3,}}+(?=@)|(?<={IN_ARGUMENT})[^\s\"']{{3,}}+|(?<={NAMED}{SET}[\"'])[^\s\"']{{4,}}+(?=[\"'])"
    rf"|(?<={NAMED}{SET}[\"']?)(?!(?i:bearer|basic|token)\s)(?:{_ANY}){{2}}(?:{_CLOSING}*+{_BODY}++)++)"
    rf"|(?<= is )(?<={TOLD})(?=\S*[0-9!@#$%^*_+])(?:{_ANY}){{2}}(?:{_CLOSING}*+{_BODY}++)++"
    r"|https?://hooks\.[A-Za-z0-9.-]{1,60}/[^\s\"'<>]{16,}+"
    r"|(?<=(?i:bearer|basic) )[A-Za-z0-9+/_.~-]{15,}[A-Za-z0-9+/_~-]={0,2}"
    r"|(?:(?<![A-Za-z0-9+/_.-])|(?<=://))(?:eyJ[A-Za-z0-9_-]{5,}+(?:\.{1,2}[A-Za-z0-9_-]++){1,4}|[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{16,}+)"
    r"|(?:(?<![A-Za-z0-9+/_-])(?!//)|(?<=://))(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
)
#: What every text with a candidate has; most texts have it not and are left alone.
MAYBE = rf"{IN_URL}|{IN_ARGUMENT}|{TOLD}|://hooks[.]|{NAMED}[\"']?[ \t]{{0,2}}[=:]|(?i:bearer|basic) |eyJ|\.[A-Za-z0-9_-]{{16}}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{16}}"
#: Stands between the parts of a cut text; texts that hold it are cut another way.
CUT = "\u0001"
#: Characters of context on each side, and of the text before the candidate before.
NEAR, BEFORE = 40, 8
#: Numbers that one step sums up.
RUN = 128
#: The dictionary: at most so many words, of a thousandth of the documents at least and no fewer than so many.
DICTIONARY, RARE, FEWEST = 2000, 1000, 5
#: Words that speak for a credential nearby, for a harmless identifier nearby, and of placeholders and paths.
CREDENTIAL = rf"(?:{NAMED}|(?i:bearer))(?![A-Za-z])"
HARMLESS = r"(?i)\b(commit|sha|sha1|sha256|md5|checksum|digest|hash|uuid|guid|revision|build|version|isbn|phone|card|account|order|invoice|id)\b"
WORDS = r"(?i)(example|sample|test|dummy|fake|placeholder|changeme|your|xxxx|user|name|data|file|path|home|lib|src|usr|local|python|java|http|www|com|org|index|config|report|image|static|assets|version|release|final|draft|page|section|table|chapter|string|true|false|none|null|required|optional|value|secret|password|token|please|enter|hidden|redacted)"

#: Trees, their depth, and the share of votes from which a candidate counts as a secret.
TREES, DEPTH, LEAST = 15, 5, 0.5
#: Labelled findings made for training if none are given.
FINDINGS, SEED = 3000, 17
MARK = "[SECRET]"

FEATURES = ("known", "length", "digits", "upper", "lower", "hex", "moves", "vowels", "covered", "separators", "groups", "credential", "harmless", "assigned", "quoted", "path", "named", "symbols", "code", "joined", "prose", "issued")


def _share(token: Column, pattern: str) -> Column:
    return F.regexp_count(token, F.lit(pattern)) / F.greatest(F.length(token), F.lit(1))


def frequent_words(docs: DataFrame, text: str = "text", most: int = DICTIONARY) -> tuple[str, ...]:
    """The ``most`` words that the most documents use, counted over all of them; a bounded list for the driver. None where fewer than FEWEST share a word."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("(?<![a-z])[a-z]{3,20}(?![a-z])"), F.lit(0)))).alias("word"))
    rows = docs.count()
    used = words.groupBy("word").count().where(F.col("count") >= max(FEWEST, rows // RARE)).orderBy(F.desc("count"), "word").limit(most)
    return tuple(r.word for r in used.collect())


def _known(token: Column, words: tuple[str, ...]) -> Column:
    """Share of a token's characters that are in words of the dictionary."""
    if not words:
        return F.lit(0.0)
    runs = F.split(F.lower(F.regexp_replace(token, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    return F.aggregate(F.filter(runs, lambda r: r.isin(*words)), F.lit(0), lambda n, r: n + F.length(r)) / F.greatest(F.length(token), F.lit(1))


def features(token: Column, left: Column, right: Column, words: tuple[str, ...] = ()) -> list[Column]:
    """FEATURES of a candidate with the text on both sides."""
    yes = lambda x: x.cast("double")
    return [
        _known(token, words),
        F.least(F.length(token), F.lit(200)).cast("double"),
        _share(token, "[0-9]"),
        _share(token, "[A-Z]"),
        _share(token, "[a-z]"),
        yes(token.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$") & token.rlike("[A-Fa-f]")),
        _share(token, r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        _share(token, "[aeiouAEIOU]"),
        1 - F.length(F.regexp_replace(token, WORDS, "")) / F.greatest(F.length(token), F.lit(1)),
        _share(token, r"[/._=+-]"),
        yes(token.rlike(r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$") | token.rlike(r"^[0-9][0-9 -]*$")),
        yes(left.rlike(CREDENTIAL)),
        yes(left.rlike(HARMLESS)),
        yes(left.rlike(r"[=:]\s*[\"']?$")),
        yes(left.rlike("[\"']$") & right.rlike("^[\"']")),
        yes(token.rlike(r"/[A-Za-z_]{2,}/|^/") | left.rlike("/$")),
        yes(left.rlike(rf"{NAMED}{SET}[\"']?$")),
        _share(token, r"[^A-Za-z0-9/._=+-]"),
        yes(token.rlike(r"[(\[{<$]|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$")),
        yes(right.rlike(r"^\.[A-Za-z0-9]") | left.rlike(r"[A-Za-z0-9_][.@]$")),
        yes(right.rlike(r"^[.,;:]?\s+[a-z]+") & ~left.rlike("[\"'=]$")),
        yes(token.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|sk_|xox[a-z]-|glpat-|AIza|eyJ|SG\.)")),
    ]


def labelled_findings(spark: SparkSession, rows: int = FINDINGS, seed: int = SEED, words: tuple[str, ...] = ()) -> DataFrame:
    """(token, left, right, label) of made-up secrets and look-alikes, half of each, by a seeded draw; look-alikes are put together from the corpus' words if they are given."""
    draw = random.Random(seed)
    of = lambda letters, n: "".join(draw.choices(letters, k=n))
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    named = ["report", "image", "user", "data", "config", "section", "release", "static", "python", "final", "draft", "index"]
    words = [*named, *words] if len(words) < 3 * len(named) else [*words]
    jwt = lambda: f"eyJ{of(low + up + digit, draw.randint(14, 33))}.eyJ{of(low + up + digit + '_-', draw.randint(20, 90))}.{of(low + up + digit + '_-', 43)}"
    plainly = ["password", "Password", "token", "TOKEN", "secret", "key", "auth", "pwd", "api_key"]
    prose = lambda: " ".join(of(low, draw.randint(2, 9)) for _ in range(4))
    found = []
    for i in range(rows):
        if i % 2:
            token = draw.choice([lambda: of("0123456789abcdef", draw.choice([32, 40, 40, 64])), lambda: "AKIA" + of(up + digit, 16), lambda: "ghp_" + of(low + up + digit, 36), lambda: "sk-" + of(low + up + digit, 40), lambda: of(low + up + digit + "+/", draw.randint(24, 60)) + "7", lambda: of(low + up + digit + "_-", draw.randint(20, 48)) + "3", jwt])()
            name = draw.choice(["token", "secret", "api_key", "password", "access_key", "auth", "client_secret", "pwd", "key", "TOKEN", "PASSWORD", "API_KEY", "AWS_SECRET_ACCESS_KEY", "Password"])
            left, right = draw.choice([(f'{name} = "', '" '), (f"{name}: ", " "), (f"{name}='", "' "), (f"{name}={'' if i % 4 else ' '}", "\n"), ("Authorization: Bearer ", " "), (f"my {name} is ", ". "), (f"{name} ", "."), (f"{name}: ", ". "), (f"{name}=", draw.choice(["&user=me", ";", ", "]))])
            if token[:3] in ("AKI", "ghp", "sk-", "eyJ"):  # known by its form, in any place
                left, right = draw.choice([(left, right), (left, right), (" ", draw.choice([" ", ". ", "@host ", "\n"])), ("https://", "@host.com/ "), ("https://me:", "@host.com/ ")])
            if draw.random() < 0.06:
                token, left, right = f"https://hooks.{of(low, 6)}.com/services/T{of(up + digit, 8)}/B{of(up + digit, 8)}/{of(low + up + digit, 24)}", draw.choice([" ", "url: ", "webhook = "]), draw.choice([" ", "\n", ". "])
            elif draw.random() < 0.36:  # passwords, short or without a digit
                word = "".join(draw.choice("bcdfghklmnprstvz") + draw.choice("aeiou") for _ in range(draw.randint(2, 5)))
                token = draw.choice([word + of(digit, draw.randint(1, 4)), word + of(digit, 1) + word[: draw.randint(2, 8)] + draw.choice(["", of(digit, 1)]), word.title() + of("!@#$%", 1) + of(digit, 2), of(low + up + digit, draw.randint(6, 15)), of(low + up, draw.randint(8, 24)), of(low + up + digit + "!@#%^*", draw.randint(8, 20)), word + of(low, 5)])
                name = draw.choice(["password", "PASSWORD", "Password", "passwd", "pwd", "PWD", "db_password", "secret", "SECRET", "token", "TOKEN", "auth", "AUTH", "key", "api_key", "API_KEY"])
                places = [(f"{draw.choice(['postgres', 'mysql', 'https', 'redis', 'amqp'])}://{of(low, draw.randint(2, 8))}:", f"@{of(low, 5)}.{of(low, 3)}/"), (f"curl -u {of(low, draw.randint(2, 8))}:", draw.choice([" ", "\n"]))]
                if any(c in digit + "!@#$%^*" for c in token):
                    places += [(f"{draw.choice(['password', 'Password', 'passcode', 'token', 'key', 'secret'])} is ", draw.choice([" ", ". ", "\n", ", "]))] * 2
                left, right = draw.choice([*places, *places, (f'{name} = "', '" '), (f'"{name}": "', '", '), (f"{name}='", "'\n"), (f"{name}=", draw.choice([" ", "\n", ". ", " and "])), (f"{name}: ", draw.choice(["\n", "\n", ". "]))])
        else:
            token, left, right = draw.choice([
                lambda: (of(digit, draw.randint(16, 19)), " ", " "),
                lambda: ("-".join(of("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), draw.choice(["uuid: ", "id = ", " "]), " "),
                lambda: (of("0123456789abcdef", 40), draw.choice(["commit ", "revision ", "sha1: ", "checksum = ", "commit=", "sha256:"]), draw.choice([" ", " ", ". ", "."])),
                lambda: ("/".join(draw.sample(words, 3)) + f"/{of(digit, 2)}_{draw.choice(words)}", draw.choice([" ", "path = ", "/", "path="]), draw.choice([" ", ".png ", ". "])),
                lambda: ("_".join(draw.sample(words, 3)) + f"_{of(digit, draw.randint(1, 8))}", draw.choice([" ", "file: ", "file="]), draw.choice([" ", ".txt ", ". "])),
                lambda: (f"{draw.choice(['example', 'your', 'dummy', 'test'])}_{draw.choice(['token', 'key', 'secret'])}_{of(digit, 4)}", draw.choice(['token = "', "api_key: ", 'password = "']), '" '),
                lambda: (of("x", draw.randint(15, 30)) + "0", 'token = "', '" '),
                lambda: (of(digit, 4) + "-" + of(digit, 4) + "-" + of(digit, 4) + "-" + of(digit, 4), " card ", " "),
                lambda: (of(low, draw.randint(14, 24)) + of(digit, 2), " ", draw.choice([" ", ". "])),
                lambda: ("-" * draw.randint(10, 20) + of(digit, 2) + "==", "\n", "\n"),
                lambda: (of(low, draw.randint(12, 20)) + of(digit, draw.randint(4, 8)), draw.choice([" ", "mail ", "mailto:"]), f"@{of(low, 6)}.com "),
                lambda: (of(low, draw.randint(10, 18)) + "-" + of(low, 6) + of(digit, 2), draw.choice([" ", "https://www.", "@mail.", "//"]), ".com/ "),
                lambda: (f"{of(low, 5)}.{of(low, 6)}.{of(low, 12)}{of(digit, 6)}", draw.choice([" ", "//"]), draw.choice([" ", ".com "])),
                lambda: (of(low + digit, draw.randint(20, 32)), draw.choice([" ", "/"]), draw.choice([".png ", ".html "])),
                lambda: (draw.choice(["string", "true", "false", "none", "null", "None", "required", "optional", "changeme", "your_password", "password", "example", "xxxxxxxx", "********", "str", "value", "hidden", "[REDACTED]"]), f"{draw.choice(plainly)}{draw.choice([': ', '=', ' = ', chr(61) + chr(34)])}", draw.choice([" ", "\n", '" '])),
                lambda: (draw.choice(["password", "pass", "PASSWORD", "secret", "xxxx", "changeme", "<password>", "${PASS}", "your_password"]), draw.choice([f"https://{of(low, 5)}:", f"postgres://{draw.choice(['user', 'username', 'me'])}:"]), "@host/"),
                lambda: (f"{of(low, draw.randint(3, 7))}_{of(low, draw.randint(3, 7))}", f"{draw.choice(['key', 'token', 'secret'])} is ", draw.choice([" ", ". "])),
                lambda: (draw.choice(["1", "2", "3rd", "64-bit", "8", "100%"]) + draw.choice(["", of(digit, 2)]), f"{draw.choice(['key', 'token', 'password'])} is ", " " + of(low, 5) + " "),
                lambda: (of(low, draw.randint(4, 9)), f"{draw.choice(plainly)}: ", " " + of(low, 3) + " " + of(low, 5) + " "),
                lambda: (draw.choice([f"get_{of(low, 5)}()", f"{of(low, 4)}({of(low, 5)})", f"${{{of(up, 6)}}}", f"os.environ[", f"self.{of(low, 6)}", f"<{of(low, 6)}>", f"${of(up, 8)}"]), f"{draw.choice(plainly)}{draw.choice([': ', '=', ' = '])}", draw.choice([" ", "\n"])),
            ])()
        found.append((token, (prose() + " " + left)[-NEAR:], (right + prose())[:NEAR], float(i % 2)))
    return spark.createDataFrame(found, "token string, left string, right string, label double")


#: A tree: 1 or 0, its vote, or (feature, whether at most the bound, bound, tree if so, tree if not).
Tree = int | tuple


def _tree(printed: str) -> Tree:
    """A tree from the form in which the model prints it; a leaf votes for its prediction."""
    lines = iter([line.strip() for line in printed.splitlines() if line.strip()])

    def node() -> Tree:
        line = next(lines)
        if m := re.match(r"Predict: ([0-9.]+)", line):
            return int(float(m[1]) > 0.5)
        m = re.match(r"If \(feature (\d+) (<=|>) (\S+)\)", line)
        yes = node()
        next(lines)  # the Else line
        return FEATURES[int(m[1])], m[2] == "<=", float(m[3]), yes, node()

    return node()


def _votes(tree: Tree, f: Column) -> Column:
    """A tree's vote over the fields of ``f``."""
    if isinstance(tree, int):
        return F.lit(tree)
    name, most, bound, yes, no = tree
    return F.when(f[name] <= bound if most else f[name] > bound, _votes(yes, f)).otherwise(_votes(no, f))


def as_vectors(findings: DataFrame, words: tuple[str, ...] = ()) -> DataFrame:
    """(label, features) of findings, for a model; nulls in texts are empty, rows without a label are left out."""
    clean = findings.where("label is not null").select("label", *[F.coalesce(c, F.lit("")).alias(c) for c in ("token", "left", "right")])
    rows = clean.select(F.col("label").cast("double").alias("label"), *[x.alias(n) for n, x in zip(FEATURES, features(F.col("token"), F.col("left"), F.col("right"), words), strict=True)])
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def fit(findings: DataFrame, words: tuple[str, ...] = ()) -> RandomForestClassificationModel:
    """The model that ``train`` writes out."""
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(as_vectors(findings, words).coalesce(1))


def train(findings: DataFrame, words: tuple[str, ...] = ()) -> list[Tree]:
    """The forest's trees, whose share of votes is a candidate's score.

    ``findings`` are (token, left, right, label): 1 a secret, 0 a false positive. Rows with a null count as having
    an empty text there; a null label is left out, repeated rows count as often as they come, other columns play
    no part. ``words`` are the dictionary, the same ones as in a scan.
    """
    return written(fit(findings, words))


def written(model: RandomForestClassificationModel) -> list[Tree]:
    return [_tree(t) for t in re.split(r"\n\s*Tree \d+ \(weight [0-9.]+\):\n", model.toDebugString)[1:]]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(text: Column) -> Column:
    """Array of what is before the first candidate, the candidate, what is between it and the next, and so on; of a text without any the text alone."""
    fast = F.split(F.regexp_replace(text, CANDIDATE, f"{CUT}$0{CUT}"), CUT, -1)
    between, found = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    slow = F.flatten(F.zip_with(between, found, lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
    return F.when(F.contains(text, F.lit(CUT)), F.slice(slow, F.lit(1), F.size(slow) - 1)).otherwise(fast)


def _sums(numbers: Column) -> Column:
    """The sum of all numbers before each one, in runs of RUN so that arrays that grow stay short."""
    grown = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(numbers), F.lit(1)) - 1) / RUN).cast("int")), lambda i: F.slice(numbers, i * RUN + 1, RUN))
    whole = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    return _let(runs, lambda r: F.flatten(F.zip_with(r, grown(F.transform(r, whole)), lambda xs, base: F.transform(grown(xs), lambda x: x + base))))


def _score(p: Column, i: Column, forest: list[Tree], words: tuple[str, ...]) -> Column:
    """The forest's share of votes for part ``i`` of a cut text."""
    end = lambda x, n: F.substring(x, F.greatest(F.length(x) - n + 1, F.lit(1)), F.lit(n))
    before = F.when(i > 2, F.concat(end(F.get(p, i - 3), BEFORE), F.lit(" "))).otherwise("")
    seen = F.struct(F.get(p, i).alias("token"), end(F.concat(before, F.get(p, i - 1)), NEAR).alias("left"), F.substring(F.get(p, i + 1), 1, NEAR).alias("right"))
    return _let(_let(seen, lambda c: F.struct(*[x.alias(n) for n, x in zip(FEATURES, features(c["token"], c["left"], c["right"], words), strict=True)])), lambda f: _compiled(forest, f))


def judged(text: Column, forest: list[Tree], words: tuple[str, ...] = ()) -> Column:
    """Array of (start, token, score) of a text's candidates; start counts characters from 0."""

    def found(p: Column) -> Column:
        many = ((F.size(p) - 1) / 2).cast("int")
        places = F.slice(F.sequence(F.lit(0), many), F.lit(1), many)
        return _let(_sums(F.transform(p, lambda x: F.length(x))), lambda at: F.transform(places, lambda k: F.struct(F.get(at, 2 * k + 1).alias("start"), F.get(p, 2 * k + 1).alias("token"), _score(p, 2 * k + 1, forest, words).alias("score"))))

    return _let(parts(text), found)


def _compiled(forest: list[Tree], f: Column) -> Column:
    """The share of votes over struct ``f``."""
    total = _votes(forest[0], f)
    for tree in forest[1:]:
        total = total + _votes(tree, f)
    return total / F.lit(float(len(forest)))


def findings(docs: DataFrame, forest: list[Tree], key: str = "doc_id", text: str = "text", least: float = LEAST, words: tuple[str, ...] = ()) -> DataFrame:
    """(key, start, n_chars, secret, score) of every secret in the whole texts, one row each.

    Start counts characters from 0; score is the share of trees that say secret, and one of ``least`` is enough.
    Null and empty texts have none; a repeated row repeats its findings; rows with null or equal keys are scanned
    alike. Other columns play no part, whatever their names; an empty table gives no rows.
    """
    some = docs.where(F.col(text).rlike(MAYBE)).select(F.col(key).alias("key"), F.explode(judged(F.col(text), forest, words)).alias("f"))
    return some.where(F.col("f.score") >= least).select(F.col("key").alias(key), F.col("f.start").alias("start"), F.length("f.token").alias("n_chars"), F.col("f.token").alias("secret"), F.col("f.score").alias("score"))


def redact(docs: DataFrame, forest: list[Tree], text: str = "text", mark: str = MARK, least: float = LEAST, words: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``.

    Rows, other columns, null texts and texts without a secret stay as they are; repeated rows are treated alike, an
    empty table stays empty.
    """
    whole = F.col(text)
    clean = _let(parts(whole), lambda p: F.array_join(F.transform(p, lambda x, i: F.when((i % 2 == 1) & (_score(p, i, forest, words) >= least), mark).otherwise(x)), ""))
    return docs.withColumn(text, F.when(F.coalesce(whole.rlike(MAYBE), F.lit(False)), clean).otherwise(whole))
