"""Names of teams, sets, brands and printings, and the rules that read them, as column expressions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from saleglass.functions.text import folded_person

# Names as they are printed, and the words that speak of a sport.
FOOTBALL_TEAMS = (
    "Arizona Cardinals", "Atlanta Falcons", "Baltimore Ravens", "Buffalo Bills", "Carolina Panthers", "Chicago Bears",
    "Cincinnati Bengals", "Cleveland Browns", "Dallas Cowboys", "Denver Broncos", "Detroit Lions", "Green Bay Packers",
    "Houston Texans", "Indianapolis Colts", "Jacksonville Jaguars", "Kansas City Chiefs", "Las Vegas Raiders",
    "Los Angeles Chargers", "Los Angeles Rams", "Miami Dolphins", "Minnesota Vikings", "New England Patriots",
    "New Orleans Saints", "New York Giants", "New York Jets", "Philadelphia Eagles", "Pittsburgh Steelers",
    "San Francisco 49ers", "Seattle Seahawks", "Tampa Bay Buccaneers", "Tennessee Titans", "Washington Commanders",
    "Washington Redskins", "Phoenix Cardinals", "Oakland Raiders", "San Diego Chargers", "St. Louis Rams",
)
FOOTBALL_ALIASES = {
    "niners": "San Francisco 49ers", "bucs": "Tampa Bay Buccaneers", "green bay": "Green Bay Packers", "tampa bay": "Tampa Bay Buccaneers",
}
BASKETBALL_TEAMS = (
    "Atlanta Hawks", "Boston Celtics", "Brooklyn Nets", "Charlotte Hornets", "Chicago Bulls", "Cleveland Cavaliers",
    "Dallas Mavericks", "Denver Nuggets", "Detroit Pistons", "Golden State Warriors", "Houston Rockets", "Indiana Pacers",
    "LA Clippers", "Los Angeles Clippers", "Los Angeles Lakers", "Memphis Grizzlies", "Miami Heat", "Milwaukee Bucks",
    "Minnesota Timberwolves", "New Orleans Pelicans", "New York Knicks", "Oklahoma City Thunder", "Orlando Magic",
    "Philadelphia 76ers", "Phoenix Suns", "Portland Trail Blazers", "Sacramento Kings", "San Antonio Spurs",
    "Toronto Raptors", "Utah Jazz", "Washington Wizards", "Seattle SuperSonics", "New Jersey Nets", "Charlotte Bobcats",
    "Vancouver Grizzlies",
)
BASKETBALL_SHORT = ("Cavs", "Mavs", "Wolves", "Sixers", "Blazers", "Sonics")
BASEBALL_TEAMS = (
    "Arizona Diamondbacks", "Atlanta Braves", "Baltimore Orioles", "Boston Red Sox", "Chicago Cubs", "Chicago White Sox",
    "Cincinnati Reds", "Cleveland Guardians", "Colorado Rockies", "Detroit Tigers", "Houston Astros", "Kansas City Royals",
    "Los Angeles Angels", "Los Angeles Dodgers", "Miami Marlins", "Milwaukee Brewers", "Minnesota Twins", "New York Mets",
    "New York Yankees", "Oakland Athletics", "Philadelphia Phillies", "Pittsburgh Pirates", "San Diego Padres",
    "San Francisco Giants", "Seattle Mariners", "St. Louis Cardinals", "Tampa Bay Rays", "Texas Rangers",
    "Toronto Blue Jays", "Washington Nationals", "Cleveland Indians", "Florida Marlins", "Montreal Expos",
    "Tampa Bay Devil Rays",
)
BASEBALL_SHORT = ("Dbacks", "Nats")
TWO_WORD_NICKNAMES = ("Red Sox", "White Sox", "Blue Jays", "Devil Rays", "Trail Blazers")
#: Nicknames of two leagues, or plain words, that prove no sport without their city.
NOT_ALONE = (
    "giants", "cardinals", "panthers", "jets", "kings", "rangers", "cavaliers", "titans", "athletics", "heat", "bucks", "jazz",
)
LEAGUE_WORDS = {
    "football": (r"football", r"nfl", r"super\s?bowl", r"quarterback", r"qb"),
    "basketball": (r"basketball", r"nba", r"wnba", r"hoops", r"slam\s?dunk"),
    "baseball": (r"baseball", r"mlb", r"world\s+series", r"pitcher", r"outfielder"),
}
ONE_SPORT_SETS = {
    "football": (r"contenders\s+optic", r"rookie\s+ticket", r"playbook", r"score\s+football"),
    "basketball": (r"court\s+kings", r"hoops", r"sky\s?box", r"fleer\s+retro"),
    "baseball": (r"bowman\s+draft", r"gypsy\s+queen", r"allen\s*&?\s*ginter", r"stadium\s+club", r"topps\s+heritage", r"bowman\s+sterling"),
}
BRANDS = (
    "Panini", "Topps", "Upper Deck", "Bowman", "Leaf", "Donruss", "Score", "Fleer", "Playoff", "Pacific", "Sage", "Press Pass",
    "Wild Card",
)
#: Sets by the maker that a title without a brand is given; those under None have none.
SETS_BY_BRAND = {
    "Panini": (
        "Prizm", "Prizm Draft Picks", "Optic", "Donruss Optic", "Mosaic", "Select", "Contenders", "Donruss", "Score", "Absolute",
        "Phoenix", "Certified", "Illusions", "Legacy", "Chronicles", "Obsidian", "Spectra", "Immaculate", "National Treasures",
        "Flawless", "Origins", "Playbook", "Zenith", "Elite", "Gold Standard", "Limited", "Impeccable", "Crown Royale", "Encased",
        "Unparalleled", "Prestige", "Luminance", "Noir", "Vertex", "XR",
    ),
    "Topps": (
        "Topps Chrome", "Chrome", "Bowman", "Bowman Chrome", "Bowman Sterling", "Stadium Club", "Museum Collection",
        "Allen & Ginter", "Gypsy Queen", "Heritage", "Finest", "Inception", "Five Star", "Gold Label", "Definitive", "Dynasty",
        "Tribute", "Fire", "Topps Now",
    ),
    "Upper Deck": ("SP Authentic", "Ultimate Collection", "Exquisite", "SPx"),
    None: (
        "Prizm Collegiate", "Select Draft Picks", "Contenders Optic", "Contenders Draft Picks", "Donruss Elite",
        "Elite Extra Edition", "Immaculate Collection", "Rookies & Stars", "Rookies and Stars", "Panini One", "Instant",
        "Topps Resurgence", "Resurgence", "Topps Midnight", "Bowman's Best", "Topps Update", "Sage Hit", "Topps", "Fleer",
        "Upper Deck", "Pacific", "Philadelphia", "Pinnacle", "Sage", "Wild Card",
    ),
}
SET_ALIASES = {
    "flagship": "Topps", "topps flagship": "Topps", "topps flagship chrome": "Topps Chrome", "flagship chrome": "Topps Chrome",
}
#: Names of inserts: sets of their own numbering inside a set, part of what a card is.
INSERTS = (
    "Micro Mosaic", "Prized Footballers", "Bomb Squad", "Season's Best", "Sunday's Best", "Dawn of a Legend", "Contours",
    "Phoenician", "Genies", "Archetype", "Notoriety", "Illuminating", "Emoji", "Sunday Kings", "Rookie Kings",
    "Rookie Recruits", "Uptowns", "Uptown", "Downtowns", "Night Moves", "Elite Series", "Gridiron Kings", "The Rookies",
    "Zero Gravity", "Full Throttle", "Power Players", "Rookie Stallions", "Round Numbers", "Legendary Lids", "Ticket Stubs",
    "Hometown Heroes", "Rookie Phenoms", "Thunderbirds", "Photogenic", "Brilliance", "Production Line", "Voltaic", "Geometric",
    "Signature Class", "Year One", "Rookie Gear", "Star Quest", "Primary Colors", "Allimination", "Battle Arena", "Kick-Off",
    "Game Gear", "Transcendent", "Multiverse", "First Pitch", "Emergent", "Fireworks", "Touchdown Masters", "Epic Performers",
    "Men of Mastery", "Kaleidoscopic", "Prizmatic", "Aurora", "Decade Dominance", "Dragonscale", "Visionary", "Super Bowl",
    "Tecmo Bowl", "Old School", "Draft Night", "Black Ink", "Xtra Points", "Player of the Day", "Rising Suns", "Rising Sons",
    "Alumination", "Joker", "Quarter-Staff", "Surge", "Anniversary", "Dragon Scale", "Draft Class", "Rookie Class", "Immortals",
    "Composite", "Paramount Pairings", "Rookie Rush", "Conductors", "Rookie Patch", "Art Card", "Select Future",
    "Five Card Draw", "Tuddys", "Protonyx", "Electro Lights", "Sandglitter", "Honeycomb", "Diamante", "Amped", "Clusters",
    "Monster Hits", "Splash of Color", "Sunday Swatches", "Fantasy Flashback", "Prizm Flashback", "Big Numbers",
    "Goodwin Champions", "Gridiron Legends", "Super Powers", "Rookie Redemption", "Epix", "Sensational Swatches",
    "Century Collection", "Fortune", "Stars and Stripes", "Stars in the Night", "Rookie Premiere", "Signature Series",
    "Autograph Series", "Rookie Signatures", "Immortal Ink", "Hall of Fame Signatures", "Championship Swatches", "Prime Patches",
    "Jumbo Patches", "Laundry Tag", "NFL Shield", "Rookie Patch Autograph", "Rookie Jersey Autograph",
)
#: Words of a kind of card that stand beside the player and name no card of its own.
DESIGNATIONS = (
    "Future Stars", "Rated Rookie", "Rated Rookies", "University Chrome", "University", "Star Rookies", "Rookie Card",
    "Rookie Ticket", "Draft Picks", "All Pro", "All-Pro", "Pro Bowl", "Team Leaders", "Record Breakers", "League Leaders",
    "Hall of Fame", "Legends", "Franchise", "Phenoms", "Sensational", "Freshman", "Class of",
)
#: Printings of a card that titles name.
PARALLELS = (
    "Color Blast", "Kaboom", "Downtown", "Stained Glass", "Night Vision", "Hyperplaid", "Light It Up", "My House", "Zoom",
    "Championship Ticket", "Playoff Ticket", "Cracked Ice Ticket", "Rookie Ticket", "Variation", "Oversized", "Horizontal",
    "Vertical", "Gold Vinyl", "Black Finite", "Silver Prizm", "Green Ice", "Red Ice", "Blue Ice", "Cracked Ice", "Tie-Dye",
    "Tie Dye", "Snakeskin", "Fast Break", "No Huddle", "Pandora", "Disco", "Hyper", "Mojo", "Shimmer", "Pulsar", "Sparkle",
    "Speckle", "Scope", "Lazer", "Laser", "Choice", "Genesis", "Reactive", "Fusion", "Flash", "Wave", "Velocity", "Shock",
    "Fluorescent", "Holo", "Camo", "Color Match", "Crackle", "Border", "Neon", "Metallix", "Dots", "Static", "Image", "Premier",
    "Preview", "SuperFractor", "Super Fractor", "X-Fractor", "XFractor", "Atomic Refractor", "Mini Diamond", "RayWave",
    "Ray Wave", "Refractor", "Concourse", "Premier Level", "Field Level", "Club Level", "Zebra", "Neon Green", "Carolina Blue",
    "Electric Etch", "Platinum", "Bronze", "Copper", "Rose Gold", "Gold", "Silver", "Black", "White", "Red", "Blue", "Green",
    "Orange", "Purple", "Pink", "Teal", "Yellow",
)
#: Words that are no part of a name; a plural counts as its singular, and a hyphen may be left out (``is_noise``).
NOISE = """
    card football nfl ncaa rookie rc ssp sp sport trading lot mint gem insert base parallel auto autograph autographed signed
    patch relic jersey psa bgs sgc cgc graded ungraded raw numbered serial pop low hot invest rare case hit mvp hof roy sealed
    pack fresh centered true pristine near condition free shipping ship the and of with for new used vintage no on in sharp
    clean beautiful nice great awesome stunning rated prospect draft pick team logo die cut short print qb rb wr te quarterback
    edition collection series die-cut 1st first year debut prizm sale read look combined bundle you choice digital reprint
    custom gem-mt nm-mt nm ex vg ex-exmint exmint nr-mint vg-vgex vgex exnm poor fair good gmcards autographden set-break break
    auction scan exact update factory jumbo oversize signature dual triple quad ebay live streaming show best all ohio texas
    alabama georgia material authentic club art class night swatches patches fabric exclusive redemption season day now real nil
    nscc collegiate heroes flashback draw numbers player kings one better singles state university college future leather
    refractor holo holofoil foil chrome wave shimmer sparkle glitter rr sr star aqua bulk investment grail comp
""".split()
#: Ends of a person's name.
SUFFIXES = "jr sr ii iii iv v".split()
#: Colours and finishes a card is printed in.
PRINTING_WORDS = """
    red blue green pink purple orange gold silver black white grey gray yellow teal aqua cyan magenta bronze copper brown tan
    navy maroon crimson scarlet violet indigo lime olive amber ruby sapphire emerald amethyst onyx pearl platinum titanium neon
    fluorescent pastel refractor prizm-refractor xfractor superfractor fractor holo holofoil foil chrome-refractor shimmer
    sparkle speckle pulsar wave mojo disco hyper scope lazer laser velocity shock flash fusion reactive crackle cracked
    snakeskin tie-dye tiedye camo mirror prism prismatic rainbow lava tiger zebra wood marble stained glass ice icy frozen
    die-cut diecut cut proof press-proof mini micro jumbo oversized metallic metallix pulsar-prizm swirl vortex genesis choice
    nebula galactic cosmic aurora eclipse solar lunar
""".split()
#: Vocabularies that an aspect of a listing feeds, by its folded name.
FACETS = {
    "playerathlete": "players", "player": "players", "set": "sets", "parallelvariety": "parallels", "parallel": "parallels",
    "insertset": "parallels", "manufacturer": "brands", "season": "seasons", "year": "seasons", "cardnumber": "card_numbers",
    "grade": "grades", "professionalgrader": "graders", "features": "features", "league": "leagues", "team": "teams",
    "sport": "sports", "yearmanufactured": "seasons", "graded": "graded", "autographed": "autographed", "countryoforigin": "countries",
}
#: Grades that labels print as words.
GRADE_WORDS = {
    "GEMMT": 10.0, "GEMMINT": 10.0, "MINT": 9.0, "NMMT": 8.0, "NM": 7.0, "EXMT": 6.0, "EX": 5.0, "VGEX": 4.0, "VG": 3.0, "GOOD": 2.0, "PR": 1.0,
}
#: Players of one name: the folded name, the other person, words of that person's teams, words of the usual one's.
NAMESAKES = (("joshallen", "Josh Hines-Allen", "jaguars jacksonville jags kentucky", "bills buffalo wyoming"),)

SETS = tuple(s for held in SETS_BY_BRAND.values() for s in held)


def nickname(team: str) -> str:
    two = [n for n in TWO_WORD_NICKNAMES if team.endswith(f" {n}")]
    return two[0] if two else team.rsplit(" ", 1)[1]


#: Every spelling of a football team and its full name; a nickname of two cities goes to the one printed last in the list.
TEAM_NAMES = {t.lower(): t for t in FOOTBALL_TEAMS} | {nickname(t).lower(): t for t in FOOTBALL_TEAMS} | FOOTBALL_ALIASES
TEAMS_OF_SPORT = {
    "football": (*TEAM_NAMES, "redskins"),
    "basketball": (*BASKETBALL_TEAMS, *map(nickname, BASKETBALL_TEAMS), *BASKETBALL_SHORT),
    "baseball": (*BASEBALL_TEAMS, *map(nickname, BASEBALL_TEAMS), *BASEBALL_SHORT),
}


def _branches(words: list[str]) -> str:
    """A pattern of words that share their beginnings, longer ones first."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    options = [(r"\s+" if c == " " else re.escape(c)) + _branches(rest) for c, rest in sorted(heads.items())]
    body = options[0] if len(options) == 1 else f"(?:{'|'.join(options)})"
    return "" if not options else f"(?:{body})?" if "" in words else body


@functools.lru_cache(maxsize=256)
def _any_of(words: tuple[str, ...]) -> str:
    starts = "".join(sorted({re.escape(c) for w in words for c in (w[0], w[0].upper())}))
    return rf"(?i)\b(?=[{starts}])({_branches(list(words))})\b"


def any_of(words) -> str:
    """A pattern of whole words or phrases, the longest at a place; any white space may stand between words."""
    return _any_of(tuple(sorted({w.lower() for w in words})))


NOISE_PATTERN = rf"^(?:{_branches(sorted({w.replace('-', '') for w in NOISE} | set(NOISE)))})s?$"
SUFFIX_PATTERN = rf"^(?:{'|'.join(SUFFIXES)})\.?$"


def is_noise(low: Column) -> Column:
    """Whether a word in lower case is no part of a name."""
    return low.rlike(NOISE_PATTERN)


def spelled(said: Column, spelling: dict[str, str]) -> Column:
    """The value under a text in lower case with single spaces; null without one."""
    entries = "\x1f".join(f"{k}\x1e{x}" for k, x in sorted(spelling.items()))
    return F.try_element_at(F.str_to_map(F.lit(entries), F.lit("\x1f"), F.lit("\x1e")), collapsed(F.lower(said)))


def collapsed(said: Column) -> Column:
    return F.trim(F.regexp_replace(said, r"\s+", " "))


def first_of(title: Column, words) -> Column:
    return F.nullif(F.regexp_extract(title, any_of(words), 1), F.lit(""))


def team_of(title: Column) -> Column:
    """Full name of the first team that a title names, in whatever spelling."""
    return spelled(first_of(title, TEAM_NAMES), TEAM_NAMES)


def canonical_set(said: Column, sets=SETS) -> Column:
    """The known set that a spelling means: itself, an alias, or what stands behind a brand; else the spelling as said."""
    known = {s.lower(): s for s in sets}
    behind = F.regexp_replace(collapsed(said), rf"^(?i)({'|'.join(sorted(BRANDS, key=len, reverse=True))}) ", "")
    return F.coalesce(spelled(said, SET_ALIASES), spelled(said, known), spelled(behind, known), collapsed(said))


def brand_of(title: Column, set_name: Column) -> Column:
    """The brand that a title names, else the maker of its set."""
    maker = {s.lower(): brand for brand, held in SETS_BY_BRAND.items() if brand for s in held}
    return F.coalesce(spelled(first_of(title, BRANDS), {b.lower(): b for b in BRANDS}), spelled(set_name, maker))


def names_printing(said: Column) -> Column:
    """Whether a name holds a colour or finish and is no set or brand itself."""
    low = F.lower(F.trim(said))
    itself = low.isin(*sorted({n.lower() for n in (*SETS, *BRANDS)} | set(SET_ALIASES)))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9'-]+"), F.lit(0))
    return ~itself & F.arrays_overlap(words, F.array(*map(F.lit, PRINTING_WORDS)))


def others_meant(title: Column) -> Column:
    """For each of ``NAMESAKES``, whether the title names the other person's team and not the usual one's."""
    return F.array(*(F.coalesce(title.rlike(any_of(theirs.split())) & ~title.rlike(any_of(ours.split())), F.lit(False)) for _, _, theirs, ours in NAMESAKES))


def namesake(player: Column, meant: Column) -> Column:
    """The other person of a shared name where ``others_meant`` says so."""
    out = player
    for i, (fold, other, _, _) in enumerate(NAMESAKES):
        out = F.when(F.get(meant, F.lit(i)) & (folded_person(player) == fold), other).otherwise(out)
    return out


def sport_of(title: Column) -> Column:
    """League word 2, set of one sport 2, team 3; the sport with the strictly highest score, null without one."""
    def score(sport: str) -> Column:
        def has(pattern: str) -> Column:
            return title.rlike(pattern).cast("int")

        teams = [t for t in TEAMS_OF_SPORT[sport] if t.lower() not in NOT_ALONE]
        league, sets = (rf"(?i)\b({'|'.join(words[sport])})\b" for words in (LEAGUE_WORDS, ONE_SPORT_SETS))
        return 2 * has(league) + 2 * has(sets) + 3 * has(any_of(teams))

    scores = F.array_sort(F.array(*(F.struct(score(s).alias("n"), F.lit(s).alias("sport")) for s in LEAGUE_WORDS)))
    best, second = scores[2], scores[1]
    return F.when((best["n"] > 0) & (best["n"] > second["n"]), best["sport"])
