"""A small labelled URL table, made up for this repository: 1 to block (spam trades), 0 to allow.

Blocked and allowed addresses mix the same top-level domains, languages, schemes and path shapes, so only what the words
of host and path say can tell them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKED = """
http://www.casino-royal.example.org/en/12
https://play-casino.example.com/de/bonus
http://casino-bet.example.net/en/88.html
https://www.best-casino.example.com/fr/7?page=2
http://blog.online-casino.example.org/es/41/
https://win-big-casino.example.net/en/free-spins
http://poker-win.example.com/en/3
https://www.poker-stars-bonus.example.org/de/19
http://m.texas-poker.example.net/fr/table/5
https://slots-win.example.com/en/jackpot
http://www.lucky-slots.example.org/es/270
https://bet-now.example.net/en/odds/14
http://sport-betting.example.com/de/quote
https://www.win-lottery.example.org/en/ticket?ref=x
http://lotto-jackpot.example.net/fr/61
https://cheap-pills.example.org/en/5
http://www.cheap-meds.example.com/de/order
https://buy-pills-now.example.net/en/77.html
http://online-pharmacy-pills.example.com/es/12
https://www.no-prescription-meds.example.org/fr/9
http://viagra-cheap.example.net/en/1
https://m.diet-pills.example.com/en/weight-loss
http://slim-fast-pills.example.org/de/31
https://www.cheap-replica.example.net/en/watches
http://replica-bags.example.com/fr/handbags/2
https://cheap-watches.example.org/es/rolex-replica
http://fast-loans.example.com/en/apply
https://www.payday-loans.example.net/en/cash
http://cheap-loans-now.example.org/de/9.html
https://quick-cash-loan.example.com/fr/approval
http://crypto-profit.example.net/en/double
https://www.bitcoin-win.example.com/en/invest-now
http://earn-money-fast.example.org/es/home
https://work-home-cash.example.net/de/55
http://www.free-prize.example.com/en/claim
https://win-prize-now.example.org/en/iphone
http://free-gift-cards.example.net/fr/8?ref=x
https://m.hot-dating.example.com/en/singles
http://www.adult-cams.example.org/en/live
https://sexy-singles.example.net/de/chat
http://xxx-videos.example.com/en/1234
https://www.adult-dating.example.org/es/77
http://download-crack.example.net/en/keygen
https://free-cracks.example.com/de/serial
http://www.warez-download.example.org/en/full-version
https://cheap-followers.example.net/en/buy
http://buy-likes.example.com/fr/instagram
https://www.seo-backlinks.example.org/en/buy-links
http://essay-writing-cheap.example.net/en/order
https://casino-free-bonus.example.com/es/vegas
http://www.casino-spins.example.net/de/3/
https://pills-cheap-online.example.com/en/offer.html
http://poker-casino.example.org/fr/14
https://www.loan-cash-fast.example.net/es/5
http://betting-win.example.com/en/tips
https://cheap-pills-shop.example.org/fr/680
http://www.casino-win-online.example.com/en/14
https://lottery-win.example.net/de/2
http://cheap-viagra-pills.example.org/en/99
http://www.casino-poker.example.com/en/win
https://casino-bonus-win.example.org/de/9
http://m.slots-casino.example.net/fr/free
https://poker-bonus.example.com/es/25
http://betting-casino.example.org/en/odds
https://www.cheap-pills-online.example.net/de/order
http://pharmacy-pills.example.org/en/cheap
https://buy-cheap-meds.example.com/fr/pills
http://www.buy-viagra.example.com/en/now
https://cheap-diet-pills.example.net/es/3
http://replica-watches-cheap.example.com/en/5
https://www.buy-replica.example.org/fr/bags
http://payday-cash-loans.example.org/en/fast
https://www.quick-loans.example.com/de/cash
http://free-cash-prize.example.net/en/win
https://win-free-iphone.example.com/en/claim
http://www.crypto-cash.example.org/en/earn-fast
https://earn-bitcoin-fast.example.net/en/7
http://adult-singles.example.com/fr/dating
https://www.sexy-cams.example.org/en/free
http://xxx-adult-videos.example.net/es/12
https://hot-adult-chat.example.com/de/live
http://crack-download.example.org/en/free
https://www.free-keygen.example.com/fr/crack
http://buy-followers-cheap.example.org/en/likes
https://cheap-backlinks.example.com/en/seo
http://lottery-jackpot-win.example.net/en/ticket
https://www.bet-win-bonus.example.org/es/8
http://loans-fast-approval.example.com/en/4
https://online-casino-slots.example.com/de/1
https://www.jackpot-slots.example.com/fr/6
""".split()

ALLOWED = """
http://www.city-library.example.org/en/12
https://garden-notes.example.com/de/rosen
http://blog.mountain-walks.example.net/en/88.html
https://www.daily-news.example.com/fr/7?page=2
http://blog.kitchen-stories.example.org/es/41/
https://open-lectures.example.net/en/free-courses
http://weather.example.com/en/3
https://www.school-board.example.org/de/19
http://m.train-times.example.net/fr/table/5
https://museum.example.com/en/exhibits
http://www.river-trust.example.org/es/270
https://science-today.example.net/en/articles/14
http://local-sport.example.com/de/tabelle
https://www.city-theatre.example.org/en/ticket?ref=x
http://history-society.example.net/fr/61
https://health-advice.example.org/en/5
http://www.hospital.example.com/de/anfahrt
https://parents-forum.example.net/en/77.html
http://language-school.example.com/es/12
https://www.chess-club.example.org/fr/9
http://street-maps.example.net/en/1
https://m.recipes.example.com/en/winter-soup
http://bird-watching.example.org/de/31
https://www.watch-repair.example.net/en/history
http://leather-craft.example.com/fr/sacs/2
https://old-books.example.org/es/catalogo
http://council.example.com/en/apply
https://www.credit-union.example.net/en/members
http://house-building.example.org/de/9.html
https://tax-office.example.com/fr/formulaires
http://maths-help.example.net/en/fractions
https://www.coding-notes.example.com/en/sorting
http://village-news.example.org/es/home
https://remote-teams.example.net/de/55
http://www.poetry-prize.example.com/en/rules
https://film-festival.example.org/en/programme
http://charity-gifts.example.net/fr/8?ref=x
https://m.dance-classes.example.com/en/beginners
http://www.zoo.example.org/en/live
https://wedding-photos.example.net/de/galerie
http://animation-videos.example.com/en/1234
https://www.book-club.example.org/es/77
http://download-docs.example.net/en/manual
https://free-software.example.com/de/lizenz
http://www.linux-users.example.org/en/full-version
https://bird-followers.example.net/en/migration
http://photo-likes.example.com/fr/portrait
https://www.web-standards.example.org/en/links
http://essay-archive.example.net/en/classics
https://opera-house.example.com/es/temporada
http://www.thereth.example.net/de/3/
https://thonan.example.com/en/offer.html
http://theran.example.org/fr/14
https://www.tionth.example.net/es/5
http://blog.thenth.example.com/en/tips
https://orther.example.org/fr/680
http://www.erthan.example.com/en/14
https://m.inghth.example.net/de/2
http://ththan.example.org/en/99
http://www.city-news.example.com/en/today
https://school-library.example.org/de/9
http://m.city-maps.example.net/fr/free
https://news-archive.example.com/es/25
http://village-school.example.org/en/times
https://www.garden-recipes.example.net/de/order
http://health-library.example.org/en/index
https://kitchen-garden.example.com/fr/notes
http://www.history-museum.example.com/en/now
https://science-museum.example.net/es/3
http://river-walks-club.example.com/en/5
https://www.mountain-club.example.org/fr/maps
http://council-news-archive.example.org/en/local
https://www.local-history.example.com/de/society
http://free-lectures.example.net/en/science
https://open-science-notes.example.com/en/articles
http://www.film-archive.example.org/en/classics
https://theatre-news.example.net/en/7
http://language-classes.example.com/fr/beginners
https://www.dance-school.example.org/en/classes
http://photo-archive.example.net/es/12
https://book-forum.example.com/de/club
http://linux-manual.example.org/en/free
https://www.free-docs.example.com/fr/manual
http://weather-maps.example.org/en/today
https://train-maps.example.com/en/times
http://charity-society.example.net/en/members
https://www.bird-society.example.org/es/8
http://house-notes.example.com/en/4
https://online-lectures.example.com/de/1
https://www.theing.example.com/fr/6
""".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label double) of the table above."""
    rows = [F.struct(F.lit(u).alias("url"), F.lit(label).alias("label")) for label, urls in ((1.0, BLOCKED), (0.0, ALLOWED)) for u in urls]
    return spark.range(1).select(F.inline(F.array(*rows)))
