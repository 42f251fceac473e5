"""URL filter: host and path rules first, then logistic regression on hashed character n-grams, trained from a small labelled table."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.llm.common import map_rows

#: Rules of the contract: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# The small labelled table (fixed values): sites to keep and to refuse, as name and path. Invented; gambling, adult content,
# advertising, spam, counterfeit goods, loans, cracked software and fraud are refused.
KEPT = """
encyclopedia-online/wiki/physics
openlibrary/books/history-of-rome
gardening-notes/2019/tomatoes
citynews/2021/05/council-meeting
python-guide/tutorial/lists
university-press/journals/biology
museum-example/collections/bronze
recipes-homecooking/soup/lentil
woodworkers/threads/1205
weather-office/forecast/north
dailyreader/stories/42117
library-school-district/reading/list.html
travel-diary/alps/hiking?page=2
mathteacher/algebra/fractions
localpaper/18231
healthadvice/articles/sleep
statistics/tables/population
railway-history/engines/1890
bookstore/catalog/novels
scienceblog/stars/how-far
citizenforum/topics/energy
chess-club/openings/sicilian
thornfield/letters/30010
poetry-archive/poems/autumn
texteditor/manual/search
farmers-weekly/livestock/sheep
townhall/minutes/1998
naturewatch/birds/robin
orchestra/season/programme
dictionary-site/words/harbour
harbour-museum/ships/cutters
northern-college/courses/optics
repair-manuals/washing-machines/pump
history-hour/episodes/77
parliament-records/debates/1974
bread-and-butter/sourdough
mountain-rescue/training
opendata-portal/v2/datasets
regional-bank/about/branches
child-care-advice/toddlers/teeth
evening-post/sport/rowing
boardgame-makers/rules/trading
theatre-north/whats-on
language-school/spanish/verbs
translation-notes/idioms
bird-atlas/species/wren
cycle-routes/coast/12
housing-charity/tenants/rights
linux-users/kernel/modules
garden-centre/roses/pruning
early-music/lute/strings
film-institute/archive/silent
electrical-code/wiring/kitchen
statistics-class/week3/regression
village-hall/events/market
veterinary-advice/cats/diet
law-review/volume/41
science-today/oceans/currents
stamp-collectors/albums
letters-home/1943/june
water-board/reservoirs
knitting-patterns/scarves
morning-herald/opinion/trains
crossword-notes/puzzles/881
hospital-trust/wards/visiting
database-guide/indexes
teachers-union/pensions
bakery-trade/flour/prices
astronomy-club/telescopes
genealogy-index/parishes
""".split()
REFUSED = """
hot-casino-bonus/slots/free-spins
xxx-videos-tube/porn/free
cheap-viagra-pills/buy/online
poker-jackpot-win/bet/bonus
adult-cams-live/xxx/webcam
free-download-crack/keygen/serial
win-big-lottery/prize/claim
escort-girls-city/adult/dating
replica-watches-cheap/rolex/buy
online-betting-odds/casino/sports
sex-chat-rooms/adult/live
payday-loans-fast/cash/apply
torrent-warez-hub/crack/games
pills-pharmacy-discount/cialis/order
nude-celebs-pics/xxx/gallery
tracker-click/banner/redirect
popunder-adserver-net/click/track
spam-links-farm/backlinks/buy
fake-login-verify/account/password
phish-bank-secure/login/verify
malware-dropper/setup.exe
casino-slots-vegas/bonus/jackpot
porn-hd-movies/sex/video
hot-singles-now/dating/xxx
crypto-doubler-scam/invest/profit
free-gift-cards-win/claim/prize
bet-now-poker/slots/odds
hentai-gallery/adult/xxx
cheap-meds-viagra/pharmacy/buy
warez-serials/download/keygen
royal-casino/1204
casino-royale-slots/play
best-bets-daily/tips
bets365-bonus/odds/77
freebets-club/join
adult-store/shop
adults-only-clips/118
adult-friend/profile
ads-server/serve/3
ads-exchange-track/pixel
click-tracker-ads/track?id=9
tracking-pixel-ads/t.gif
spam-mailer/bulk
link-farm-seo/links/1
content-farm-spam/articles/55
cheap-cialis/order
discount-pills-online/pills
cheap-pills-shop/cart
win-cash-now/spin
win-prizes-free/draw
slots-win-big/games
sexy-cams/room/4
livesex-girls/now
xxx-tube-free/watch/991
porn-archive/top
mature-porn-clips/22
fast-cash-loans/apply
no-credit-payday/loan
replica-bags-cheap/sale
fake-id-cards/order
keygen-cracks/serials
cracked-apps-warez/apk
buy-followers-cheap/plans
get-rich-crypto/signals
bitcoin-doubler/deposit
miracle-diet-pills/offer
casino-no-deposit/bonus
betting-tips-win/vip
lottery-winner-claim/form
hacked-accounts-sale/list
""".split()
#: Every site stands in the table under some of these, dealt in turn, so that they don't tell the classes apart.
LEADS, DOMAINS = ["www.", "", "m.", "blog.", "en."], [".com", ".org", ".net", ".info"]
BUCKETS, SHORT, LONG = 1 << 13, 3, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def grams(part: str, kind: str) -> set[int]:
    """Buckets of the character 3- to 5-grams of a host or path with its ends marked."""
    marked = f"^{part}$"
    return {zlib.crc32(f"{kind}{marked[i : i + n]}".encode()) % BUCKETS for n in range(SHORT, LONG + 1) for i in range(len(marked) - n + 1)}


#: What ``fit_urls`` chooses from: penalties, and the thresholds above which a score blocks.
RIDGES, THRESHOLDS, FOLDS = (1e-4, 1e-3, 1e-2), (0.4, 0.5, 0.6, 0.7, 0.8), 5


def addresses(sites: Sequence[str]) -> list[str]:
    """Host and path of each site, under two of the leads and domains."""
    out = []
    for i, site in enumerate(sites):
        name, slash, path = site.partition("/")
        out += [f"{LEADS[(i + 2 * k) % len(LEADS)]}{name}{DOMAINS[(i + k) % len(DOMAINS)]}{slash}{path}" for k in (0, 1)]
    return out


def _rows(urls: Sequence[str]) -> np.ndarray:
    """One row of length 1 a url: its grams all weigh the same."""
    rows = np.zeros((len(urls), BUCKETS))
    for i, url in enumerate(urls):
        host, slash, path = url.partition("/")
        at = list(grams(host, "h") | grams(slash + path, "p"))
        rows[i, at] = 1 / np.sqrt(len(at))
    return rows


def train(inner: np.ndarray, aim: np.ndarray, ridge: float = 1e-3, epochs: int = 300, rate: float = 4.0) -> tuple[np.ndarray, float]:
    """Each row's share in the weights, and the intercept, of the logistic regression on rows with these inner products.

    Full gradient steps, so the fit has no chance in it. The weights always are a sum of rows, so the steps go over the
    rows' shares and not over the buckets.
    """
    share, intercept = np.zeros(len(aim)), 0.0
    for _ in range(epochs):
        off = 1 / (1 + np.exp(-(inner @ share + intercept))) - aim
        share -= rate * (8 / len(aim) * off + ridge * share)
        intercept -= rate / 8 * off.mean()
    return share, intercept


@dataclass
class UrlModel:
    """Weights, intercept and the score from which a url is blocked; what cross-validation found for them."""

    weights: np.ndarray
    intercept: float
    threshold: float
    ridge: float
    recall: float
    precision: float


def fit_urls(kept: Sequence[str] = KEPT, refused: Sequence[str] = REFUSED, precise: float = 0.95) -> UrlModel:
    """The model of a small labelled table. Penalty and threshold are those with the largest recall of refused rows, among the
    ones whose cross-validated precision is at least ``precise`` (without any, the most precise); folds go by site."""
    rows = _rows([*addresses(kept), *addresses(refused)])
    aim = np.repeat([0.0] * len(kept) + [1.0] * len(refused), 2)
    fold = np.repeat(np.concatenate([np.arange(len(kept)) % FOLDS, np.arange(len(refused)) % FOLDS]), 2)
    inner, found = rows @ rows.T, []
    for ridge in RIDGES:
        score = np.zeros(len(aim))
        for k in range(FOLDS):
            share, intercept = train(inner[np.ix_(fold != k, fold != k)], aim[fold != k], ridge)
            score[fold == k] = 1 / (1 + np.exp(-(inner[np.ix_(fold == k, fold != k)] @ share + intercept)))
        for threshold in THRESHOLDS:
            blocked = score >= threshold
            right = float((blocked & (aim == 1)).sum())
            found.append((right / max(1.0, aim.sum()), right / max(1.0, float(blocked.sum())), ridge, threshold))
    recall, precision, ridge, threshold = max(found, key=lambda x: (x[1] >= precise, x[0] if x[1] >= precise else x[1], x[1]))
    share, intercept = train(inner, aim, ridge)
    return UrlModel(rows.T @ share, intercept, threshold, ridge, recall, precision)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    rest = F.coalesce(F.element_at(F.split(url, "://", 2), 2), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, rest).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none: its host or a subdomain of it, and a path that starts with its path."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: UrlModel | None = None) -> DataFrame:
    """One row a page: id, host, path, rule (null if none fits), verdict, and the model's score.

    A rule's verdict stands; else a score of the model's threshold or more blocks. Null and malformed urls have an empty host
    and path; they meet no rule, their score is 0, and they are allowed. Rows that repeat are judged each; an empty table
    gives no row. One pass, no shuffle.
    """
    model = model or fit_urls()

    def start() -> Callable[..., list[tuple]]:
        hosts: dict[str, frozenset[int]] = {}

        def each(page: int | None, host: str, path: str, rule: str | None, verdict: str | None) -> list[tuple]:
            of_host = hosts.get(host)
            if of_host is None:
                of_host = frozenset(grams(host, "h"))
                if len(hosts) < 100_000:
                    hosts[host] = of_host
            at = list(of_host | grams(path, "p")) if host or path else []
            score = float(1 / (1 + np.exp(-(model.weights[at].sum() / len(at) ** 0.5 + model.intercept)))) if at else 0.0
            return [(page, host, path, rule, verdict or ("block" if score >= model.threshold else "allow"), score)]

        return each

    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).cast("bigint").alias("_id"), host.alias("_host"), path.alias("_path"))
    found = parts.withColumn("_r", longest_rule(F.col("_host"), F.col("_path"), rules)).select("_id", "_host", "_path", "_r.rule", "_r.verdict")
    return map_rows(found, start, f"{id_col} bigint, host string, path string, rule string, verdict string, score double")
