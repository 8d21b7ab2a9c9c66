"""Rule lists of the cleaning functions. All of them are fixed values: results depend on each entry and on the order."""

# Site patterns, removed first, in this order.
SITE_PATTERNS = [
    r"(?i)allindiandjsdrive", r"(?i)mp3virus", r"(?i)djmaza", r"(?i)songspk", r"(?i)pagalworld", r"(?i)djpunjab",
    r"(?i)masstamilan(?:\.dev)?", r"(?i)\.dev\b", r"(?i)tamilwire", r"(?i)tamilrockers?", r"(?i)isaimini", r"(?i)tamildbox",
    r"(?i)tamilyogi", r"(?i)moviesda", r"(?i)kuttymovies", r"(?i)www\.[\p{L}\p{N}_]+", r"(?i)\.(?:com|in|net|org|co|dev|biz)\b",
    r"\[.*?\.(?:com|in|net|org|dev).*?\]", r"\(.*?\.(?:com|in|net|org|dev).*?\)",
]
# Promotion patterns, removed next, in this order.
PROMO_PATTERNS = [
    r"(?i)\(Full Audio Song\)", r"(?i)\(Full Song\)", r"(?i)\(Audio\)", r"(?i)\(Official\)", r"(?i)320kbps", r"(?i)Free Download",
    r"(?i)High Quality", r"(?i)Tamil \d{4}", r"(?i)Hindi \d{4}", r"(?i)\[Tamil\]", r"(?i)\[Hindi\]", r"(?i)\[Punjabi\]", r"(?i)\(\d{4}\)",
]
# Remarks that stay.
KEPT_PATTERNS = [r"(?i)\(Remix\)", r"(?i)\(Club Mix\)", r"(?i)\(Extended Mix\)", r"(?i)\(Radio Edit\)", r"(?i)\(Unplugged\)", r"(?i)\(Live\)"]
# Substrings that mark a polluted text, besides the site patterns.
POLLUTED = ["masstamilan", "tamilwire", "isaimini", "djmaza", ".com", ".in", ".dev", ".net", ".org", ".co", "www.", "http", "download", "free"]
# References to download sites and promotion, and their order.
DOWNLOAD_PATTERNS = [
    r"(?i)(?:www|http:|https:)+[^\s]+[\w]", r"(?i)\b\w+\.com\b", r"(?i)\b\w+\.co\.\w{2}\b", r"(?i)\b\w+\.net\b", r"(?i)\b\w+\.org\b",
    r"(?i)\bdownload(?:ed)?(?:\s+from)?\s+\w+\b", r"(?i)\bfrom\s+\w+\.\w+\b", r"(?i)\bwww(?:\s|\.)+\w+(?:\s|\.)+\w+\b",
    r"(?i)\b(?:follow|like|subscribe)\s+(?:us|me)?\s+(?:on|at)?\s+\w+\b", r"(?i)\b@\w+\b",
    r"(?i)\bexclusive\b", r"(?i)\bpromotional\s+(?:use|copy)\b", r"(?i)\bcourtesy\s+of\b", r"(?i)\b(?:free|premium)\s+download\b",
]
# Site names of the strict profile: those it removes as words, those whose brackets go, those that end a text after a dash,
# and those that make a text junk; and its endings of addresses.
STRICT_SITES = [
    "masstamilan", "djmaza", "songspk", "pagalworld", "djpunjab", "tamilwire", "tamilrockers", "isaimini", "tamildbox", "tamilyogi", "moviesda", "kuttymovies",
]
STRICT_WORDS = ["tamilrocker", "starmusiq", "vmusiq", "downloadsouthmp3", "uyirvani", "tamiltunes", "sensongsmp3", "scenerockers"]
STRICT_ENDS = ["starmusiq"]
STRICT_JUNK = ["tamilrocker", "starmusiq", "vmusiq"]
DOMAINS = ["com", "net", "org", "in", "dev", "co", "biz", "info", "so"]
# Labels that the comparison key ignores.
MIX_LABELS = [r"\(original mix\)", r"\(radio edit\)", r"\(extended mix\)", r"\(club mix\)", r"\(dub mix\)", r"\(instrumental\)", r"\(remix\)", r"\(remastered\)", r"\d{4}"]
# Words that token sets ignore.
STOP_WORDS = ["the", "a", "an", "feat", "ft", "and"]
# Keywords of comment lines that stay.
COMMENT_KEYWORDS = ["quality", "dynamic range", "energy", "dj cues", "loudness normalized", "camelot", "key:", "bpm:", "dr", "lufs", "rms", "peak"]
# Genre by substring, the first that fits; else Indian.
GENRE_WORDS = [
    ("Tamil", ["tamil", "kollywood", "chennai", "madras"]),
    ("Bollywood", ["bollywood", "hindi", "mumbai", "playback"]),
    ("Electronic", ["remix", "club", "dance", "dj", "electronic"]),
    ("Tamil", ["rahman", "ilaiyaraaja", "yuvan", "anirudh", "harris", "devi sri prasad"]),
]
# Genre by a word of the path.
GENRE_PATHS = [("Tamil", ["tamil"]), ("Telugu", ["telugu"]), ("Bollywood", ["hindi", "bollywood"]), ("Punjabi", ["punjabi"])]
# Canonical genres.
GENRE_NAMES = {
    "tamil": "Tamil", "bollywood": "Bollywood", "indian": "Indian", "classical": "Indian Classical", "devotional": "Devotional", "folk": "Folk",
    "fusion": "Fusion", "electronic": "Electronic", "pop": "Pop", "rock": "Rock", "hip hop": "Hip Hop", "dance": "Dance", "world music": "World Music",
}
# Tempo by genre; else 120.
GENRE_BPM = {"Tamil": "120", "Bollywood": "115", "Electronic": "128", "Dance": "130", "Hip Hop": "90", "Pop": "120", "Rock": "140"}
# Weights of missing fields.
FIELD_WEIGHTS = {"title": 10, "artist": 9, "bpm": 8, "key": 8, "energy": 7, "genre": 6, "album": 4, "year": 3}
# Text frames with their fields, and those that hold lists of people.
FRAMES = {
    "TIT2": "title", "TPE1": "artist", "TALB": "album", "TPE2": "album_artist", "TPE3": "conductor", "TPE4": "remixer", "TEXT": "lyricist", "TCOM": "composer",
    "TCON": "genre", "TOLY": "original_lyricist", "TCOP": "copyright", "TENC": "encoded_by", "TIT1": "content_group", "TIT3": "subtitle",
    "TOPE": "original_artist", "TPUB": "publisher", "TSRC": "isrc", "TIPL": "involved_people",
}
PEOPLE_FRAMES = ["TPE1", "TPE2", "TPE3", "TPE4", "TEXT", "TCOM", "TOLY"]
# Key profiles, pitches and wheel codes.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
CAMELOT = {
    "C": "8B", "G": "9B", "D": "10B", "A": "11B", "E": "12B", "B": "1B", "F#": "2B", "C#": "3B", "G#": "4B", "D#": "5B", "A#": "6B", "F": "7B",
    "Am": "8A", "Em": "9A", "Bm": "10A", "F#m": "11A", "C#m": "12A", "G#m": "1A", "D#m": "2A", "A#m": "3A", "Fm": "4A", "Cm": "5A", "Gm": "6A", "Dm": "7A",
}
