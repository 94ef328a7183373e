"""URL filters: rules on host and path, and a logistic regression on hashed character
n-grams of both for the URLs that no rule decides.

The classifier learns from a small labelled table of URLs (``labelled_urls``, a
parameter).  The default table is put together from subjects, not from sites: words for
what public block lists are about (gambling, pornography, pharmacy spam, tracking,
malware, phishing, warez, loans) and words for what ordinary sites are about, both in the
same forms of host, under the same top-level domains and on the same paths, so that only
the subject tells the labels apart.

Judging is one scan of the URL column without a shuffle; the weights are a table of fixed
size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeworks.llm.common import mix, tune
from gaugeworks.llm.training import sigmoid

SLOTS, UNKNOWN = 1 << 18, -2.0
SIZES = (3, 4, 5)
#: Invented names in the default table.
INVENTED = 1200
#: Characters of URLs whose n-grams are held at a time.
STEP_CHARACTERS = 1 << 19

#: Subjects of block lists and of ordinary sites.
UNWANTED = {
    "gambling": "casino poker roulette blackjack slots jackpot betting bets sportsbook bookmaker wager lottery lotto baccarat bingo gambling",
    "pornography": "porn porno xxx sex sexy nude naked erotic hentai webcam camgirls escort milf fetish adult hardcore",
    "pharmacy spam": "viagra cialis levitra pills pharma pharmacy xanax tramadol steroids weightloss diet meds",
    "tracking": "adserver advert adclick banners popunder popup tracker tracking clicktrack beacon affiliate doubleclick",
    "malware": "malware trojan spyware ransomware keylogger botnet exploit virus rootkit",
    "phishing": "phishing verify-account login-secure account-update spoof scam fraud",
    "warez": "warez crack cracked keygen serials nulled torrent pirate freedownload",
    "spam": "spam spammer linkfarm doorway seoboost getrich freemoney clickbait replica",
    "loans": "payday payloan fastcash instantloan creditrepair forex binaryoptions",
}
ORDINARY = """
news daily times herald journal gazette tribune weather science nature physics chemistry biology math history
museum library archive university college school academy teacher student research institute society council
government city village county state travel hotel train railway airport airline garden kitchen recipe cooking
food coffee bakery restaurant health hospital clinic doctor sport football tennis cycling running music concert
orchestra theatre film cinema radio television book author poetry novel language dictionary translate grammar
software developer code linux python data cloud computer network hardware phone camera photo design art gallery
painting craft furniture house home family children baby toys games puzzle chess forum blog diary letter mail
shop store market clothing shoes fashion jewelry bank insurance finance economy business company office jobs
career law court police fire rescue army church temple charity volunteer environment energy water forest river
ocean mountain island farm animal horse dog cat bird fish flower tree map globe atlas
""".split()
#: Parts of invented names, such as brands have; they are ordinary too.
OPENINGS = "b br c ch cl d dr f fl g gr h j k l m n p pl qu r s sh st t th tr v w z".split()
MIDDLES = "a ai e ea i ia o oo u".split()
CLOSINGS = "b ck d g l ll m n nd ng nt p r rd rt s sh ss st t th v x".split()
FORMS = ("{}", "the{}", "{}-online", "my-{}", "{}world", "best{}s", "{}24", "{}-center")
BEFORE = ("", "www.", "m.", "blog.")
ENDINGS = ("com", "net", "org", "info", "de", "fr", "es", "co.uk")
PATHS = ("/", "/index.html", "/en/about", "/de/2041", "/fr/12.html", "/es/page/7", "/2024/05/31", "/article?id=5", "", "/en/88", "/docs/guide")
#: Paths that speak of an unwanted subject, whatever the host.
PATH_FORMS = ("/{}/index.html", "/en/{}-offer", "/buy/{}", "/go/{}/12")


def invented(k: int) -> str:
    """The k-th invented name, of two or three syllables."""
    turn = lambda parts, step, shift: parts[(k * step + shift) % len(parts)]
    syllables = [turn(OPENINGS, 7 + 4 * n, 5 * n) + turn(MIDDLES, 5 + 2 * n, n) + (turn(CLOSINGS, 3 + 7 * n, 2 * n) if (k + n) % 3 else "") for n in range(2 + k % 2)]
    return "".join(syllables)


def labelled_urls() -> list[tuple[str, int]]:
    """The default small labelled table: (url, 1 if it is to be blocked).  A word meets
    forms, endings and paths by the same turns, whatever its label."""
    out = []
    unwanted = [w for words in UNWANTED.values() for w in words.split()]
    for label, words in ((1, unwanted), (0, ORDINARY), (0, [invented(k) for k in range(INVENTED)])):
        for k, word in enumerate(words):
            for n in range(6 if label else 2):
                host = FORMS[(k + n) % len(FORMS)].format(word) + "." + ENDINGS[(k + 3 * n) % len(ENDINGS)]
                out.append((f"https://{BEFORE[(k + 2 * n) % len(BEFORE)]}{host}{PATHS[(5 * k + n) % len(PATHS)]}", label))
    for k, word in enumerate(unwanted):
        for n in range(2):
            host = FORMS[(k + n) % len(FORMS)].format(ORDINARY[(7 * k + 3 * n) % len(ORDINARY)]) + "." + ENDINGS[(k + n) % len(ENDINGS)]
            out.append((f"https://{host}{PATH_FORMS[(k + n) % len(PATH_FORMS)].format(word)}", 1))
    for k, word in enumerate(ORDINARY):
        host = FORMS[(k + 1) % len(FORMS)].format(ORDINARY[(11 * k + 5) % len(ORDINARY)]) + "." + ENDINGS[(k + 2) % len(ENDINGS)]
        out.append((f"https://{host}{PATH_FORMS[k % len(PATH_FORMS)].format(word)}", 0))
    return out


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased;
    path: from there up to '?', '#' or the end.  Both empty without '://'."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


class Rules:
    """Verdicts for hosts (with all subdomains) and path prefixes; the longest wins."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((slash + path, rule, verdict))
        self.longest = max(map(len, self.by_host), default=0)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, at = None, 0
        while at < len(host):
            name = host[at:] if len(host) - at <= self.longest else ""
            for prefix, rule, verdict in self.by_host.get(name, ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else len(host)
        return best


def gram_keys(texts: list[str], salt: int) -> np.ndarray:
    """Number of the text * SLOTS + slot of every character n-gram of the texts, each
    between two marks."""
    marked = [f"^{t}$" for t in texts]
    size = np.array([len(t) for t in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the text's end
    out, rolled = [], np.full(len(code), salt, np.uint64)
    for n in range(1, max(SIZES) + 1):
        ahead = np.zeros(len(code), np.uint64)
        ahead[: max(0, len(code) - n + 1)] = code[n - 1 :]
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + ahead + np.uint64(1))
        if n in SIZES:
            inside = left >= n
            out.append(of[inside] * SLOTS + (rolled[inside] % np.uint64(SLOTS)).astype(np.int64))
    return np.concatenate(out)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(URL, slot) of the distinct n-grams of hosts and of paths, which differ by their salt."""
    keys = np.concatenate([np.unique(gram_keys(hosts, 1)), np.unique(gram_keys(paths, 2))])
    return keys // SLOTS, keys % SLOTS


def train(table: list[tuple[str, int]]) -> np.ndarray:
    """Weights by slot and a constant (last): logistic regression by gradient descent.
    The constant stays at ``UNKNOWN``, so that a URL without known n-grams is allowed."""
    parts = [host_and_path(u) for u, _ in table]
    at, slot = features([h for h, _ in parts], [p for _, p in parts])
    norm = 1 / np.sqrt(np.bincount(at, minlength=len(table)).clip(1))
    rare = np.log(len(table) / np.bincount(slot, minlength=SLOTS).clip(1)) ** 2  # n-grams of most URLs tell little
    y = np.array([v for _, v in table], float)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = np.zeros(SLOTS)
    for _ in range(400):
        z = np.bincount(at, (w * rare)[slot], len(table)) * norm + UNKNOWN
        d = share * (sigmoid(z) - y)
        w -= 0.1 * (np.bincount(slot, d[at] * norm[at], SLOTS) * rare + 1e-4 * w)
    return np.append(w * rare, UNKNOWN)


def probabilities(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """That the URLs are to be blocked, in steps of bounded size."""
    out, lo, size = [np.zeros(0)], 0, np.cumsum([len(h) + len(p) for h, p in zip(hosts, paths, strict=True)])
    while lo < len(hosts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + STEP_CHARACTERS, "right")))
        at, slot = features(hosts[lo:hi], paths[lo:hi])
        n = np.bincount(at, minlength=hi - lo)
        out.append(sigmoid(np.bincount(at, weights[slot], hi - lo) / np.sqrt(n.clip(1)) + weights[-1]))
        lo = hi
    return np.concatenate(out)


def judge(pages: DataFrame, rules: list[tuple[str, str]], table: list[tuple[str, int]] | None = None, *, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per page row: its id, ``host``, ``path``, ``rule`` (or null), ``verdict``
    (allow or block) and ``score`` (the classifier's, of every URL).

    A null URL or one without '://' has an empty host and path, fits no rule and is left
    to the classifier.  Of rules that fit the longest wins, of equally long ones the first.
    URLs of any length are read whole; a null id is passed through.  Repeated rows give
    repeated results; an empty table gives none; other columns are ignored.
    """
    tune(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((rules, train(table if table is not None else labelled_urls())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, weights = Rules(shared.value[0]), shared.value[1]
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
            found = [fits.find(*p) for p in parts]
            score = probabilities(weights, [p[0] for p in parts], [p[1] for p in parts])
            verdict = [f[1] if f else "block" if s >= threshold else "allow" for f, s in zip(found, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array([f[0] if f else None for f in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score)],
                names=[id_col, "host", "path", "rule", "verdict", "score"],
            )

    return pages.select(id_col, url_col).mapInArrow(work, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")
