"""What ordinary tokens look like to the battery of ``secret_scan``, by encoding.

A fixed reference of ordinary tokens (words of four languages and of programs, joined as identifiers,
paths and numbers are) is made once in the driver.  It does not depend on the input, so a small and a
large table are judged alike.  For each encoding four additive statistics are fitted on it: use of the alphabet
(log of uniform over ordinary share), runs about the middle and lag-one product, with the characters ranked
by ordinary share, and changes of class (lower, upper, digit, mark).  Their weighted sum has mean ``mu * n`` and, at lengths near ``n``, a spread that covers
the reference's upper tail.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cache
from statistics import NormalDist

import numpy as np

KNOTS = (20, 24, 32, 48, 64, 96, 128)
WORDS = """the and for with that this from have not are was were will would there their what about which when make like time just know
people into year good some could them other than then look only come over think also back after use two how work first well way even
new want because any give day most account address array builder button cache callback channel class client cloud code color command
component config connection container context controller count create current data database date default delete description device
document element email enable error event exception export factory field file filter format frame function group handler header height
history image implementation import index information input instance interface internal item key language layout length level library
list load local location manager map message method model module name network node number object option output package page parameter
parser path payment position process product profile project property proxy query queue record reference register remove report request
resource response result route schema screen search select server service session setting singleton size source start state status
storage stream string style summary system table target task template test text thread title token transaction type update upload
user utility validation value vector version video view window worker zone quick jump exact fix box yellow hyphen organization management
der die und das nicht mit sich auf eine von werden haben einer wurde durch zwischen jahr zeit arbeit straße gesellschaft entwicklung
versicherung verwaltung schaft lichkeit keiten ungen heit wirtschaft bundes haupt kraft werk zeug fahrt schule bericht zahl groesse
le les des que pour dans une est avec sur plus par pas ne au nous vous entre aussi bien ministere gouvernement quelque toujours beaucoup
maison travail pays temps chose homme femme enfant eau jour elle aux ment tion naissance ecole francais nouveau premier
el los las del por para con una como pero sus este entre cuando muy sin sobre tambien hasta hay donde quien desde todo nos durante
estados uno ellos mundo ciudad gobierno trabajo nacion empresa mente cion dad tiempo agua pueblo desarrollo ejemplo general""".replace("ß", "ss").split()


@dataclass(frozen=True)
class Ordinary:
    use: list[float]  # for each character of the alphabet
    rank: list[float]  # by ordinary share, centred
    weights: tuple[float, float, float, float]
    mu: float
    spread: list[float]  # at the knots, for the square root of the length


def _number(rng: random.Random) -> str:
    return rng.choice([lambda: str(rng.randrange(1, 30)), lambda: str(rng.randrange(1980, 2031)), lambda: f"{rng.randrange(300):04d}",
                       lambda: f"20{rng.randrange(10, 30)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}", lambda: f"{rng.randrange(10 ** 6):06d}",
                       lambda: str(rng.randrange(1, 10) * 10 ** rng.randrange(1, 5))])()


def _token(encoding: str, letters: str, rng: random.Random, n: int) -> str:
    """An ordinary token of at least ``n`` characters in its encoding."""
    digits = rng.choice([0.0, 0.1, 0.3]) if any(c in letters for c in "23") else 0.0
    style = rng.choice(["camel", "camel", "lower", "mixed"])
    sep = rng.choice(["_", "-", "-", "_", "/"] if encoding in ("base64url", "mixed") else ["/"] if encoding == "base64" else [""])
    if encoding in ("HEX", "base32", "upper"):
        style = "upper"
    if encoding in ("lower", "base36"):
        style = "lower"
    hexed = [w for w in WORDS + ["add", "bad", "face", "bed", "dead", "feed", "cafe", "decade", "abc", "ac", "de", "a", "b", "c", "e", "f"] if set(w) <= set("abcdef")]
    out, size = [], 0
    while size <= n:
        if rng.random() < (0.6 if encoding == "HEX" else digits):
            piece = _number(rng)
        else:
            w = rng.choice(hexed if encoding == "HEX" else WORDS)
            piece = {"camel": w.capitalize(), "lower": w, "upper": w.upper(),
                     "mixed": rng.choice([w.upper() if len(w) < 5 else w.capitalize(), w, w.capitalize()])}[style]
        piece = "".join(c for c in piece if c in letters)
        out.append(piece)
        size += len(piece) + len(sep)
    return sep.join(out)


@cache
def fit(encoding: str, letters: str, tokens: int = 4000) -> Ordinary:
    rng, n, k = random.Random(encoding), KNOTS[-1], len(letters)
    at = np.full(128, k - 1)
    at[[ord(c) for c in letters]] = np.arange(k)
    x = np.stack([at[np.frombuffer(_token(encoding, letters, rng, n)[:n].encode(), np.uint8)] for _ in range(tokens)])
    share = (np.bincount(x.ravel(), minlength=k) + 0.002 * x.size / k) / (x.size * 1.002)
    use = np.minimum(-np.log(k * share), 3.0)
    rank = np.empty(k)
    rank[np.argsort(-share, kind="stable")] = (np.arange(k) - (k - 1) / 2) / k
    kind = np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in letters])
    y = np.random.default_rng(k).integers(0, k, (tokens, n))

    def stats(t: np.ndarray) -> np.ndarray:  # sums over the first 1..n characters
        r = rank[t]
        c = kind[t]
        pair = np.stack([(r[:, 1:] > 0) != (r[:, :-1] > 0), r[:, 1:] * r[:, :-1], c[:, 1:] != c[:, :-1]], -1).astype(float)
        pair = np.concatenate([np.zeros((len(t), 1, 3)), pair], 1)
        return np.cumsum(np.concatenate([use[t][..., None], pair], -1), 1)

    a, b = stats(x), stats(y)
    a32, b32 = a[:, 31] / 32, b[:, 31] / 32
    w = np.linalg.pinv(np.cov(a32.T) + np.cov(b32.T)) @ (b32.mean(0) - a32.mean(0))
    mu = float((a32 @ w).mean())
    spread = []
    for m in KNOTS:
        z = (a[:, m - 1] @ w - mu * m) / m ** 0.5
        spread.append(max(float(np.quantile(z, q)) / NormalDist().inv_cdf(q) for q in (0.9, 0.99, 0.999)))
    return Ordinary(use.tolist(), rank.tolist(), tuple(w.tolist()), mu, spread)
