"""Word lists and constants that must equal the analysed script's.

They are given plainly, in their natural order, as the script and the public
stop-word list state them.
"""

from __future__ import annotations

# Lead types that are not online news (null is excluded as well).
EXCLUDED_LEAD_TYPES = ("Longform", "Full Width")

# Features removed from the label document-feature matrix.
LABEL_REMOVALS = ("uncategorized", ",")

# The public Snowball English stop-word list (175 words).
SNOWBALL_ENGLISH = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "would", "should", "could", "ought", "i'm", "you're", "he's",
    "she's", "it's", "we're", "they're", "i've", "you've", "we've", "they've", "i'd", "you'd", "he'd",
    "she'd", "we'd", "they'd", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "isn't", "aren't",
    "wasn't", "weren't", "hasn't", "haven't", "hadn't", "doesn't", "don't", "didn't", "won't", "wouldn't",
    "shan't", "shouldn't", "can't", "cannot", "couldn't", "mustn't", "let's", "that's", "who's", "what's",
    "here's", "there's", "when's", "where's", "why's", "how's", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "will",
)

# The 53 hand-picked stop words of the analysed script.
CUSTOM_STOPWORDS = (
    "also", "make", "time", "year", "like", "take", "just", "people", "video", "user", "first", "work",
    "image", "show", "come", "well", "know", "look", "good", "include", "even", "world", "tell", "game", "want",
    "find", "last", "call", "think", "week", "many", "give", "post", "mashable", "late", "still", "medium", "need", "dont",
    "back", "much", "share", "around", "since", "thing", "month", "youre", "team", "part", "thats", "long", "next", "another",
)

# The script's (switched-off) list of entities kept out of lexicon growth.
ENTITY_EXCLUSIONS = (
    "facebook", "mashable", "iphone", "instagram", "flickr", "microsoft", "ipad", "smartphone", "samsung",
    "tumblr", "obama", "istockphoto", "francisco", "netflix", "reddit", "sony", "kickstarter", "xbox", "angeles",
    "facebooks", "linkedin", "ferguson", "chris", "steve", "ferguson", "uber", "spotify", "snowden", "itunes",
    "snapchat", "bitcoin", "pinterest", "islamic", "mashables", "playstation", "microsofts", "iphones", "hong",
    "eric", "kevin", "bluetooth", "zuckerberg", "brian", "nokia", "samsungs", "verizon", "kong", "gmail", "justin",
    "ryan", "bloomberg", "obamas", "jeff", "imgur", "sxsw", "espn", "sochi", "intel", "ipads", "airbnb", "tony",
    "nintendo", "whatsapp", "alex", "jennifer", "skype", "motorola", "william", "cameron", "dropbox", "icloud",
    "tmobile", "comcast", "hulu", "starbucks", "wikileaks", "diego", "itll", "emoji", "ebay", "ipod", "miley", "siri",
    "fallon", "beiber", "fifa", "evernote", "wikipedia", "andy", "sonys", "spacex", "vladimir", "charlie", "inner",
    "pete", "iwatch", "walmart", "indiegogo", "gameplay", "etsy", "kate", "dave", "kimmel", "ballmer", "larry",
    "steven", "macbook", "mcdonalds", "comiccon", "michelle", "paypal", "neil", "instagrams", "buzzfeed", "forbes",
    "firefox", "roku", "beyonce", "sharknado", "swartz", "abbott", "nielsen", "beyonc", "nypd", "emmys", "cupertino",
    "marissa", "nadella", "lebron", "francis", "gaga", "phil", "keith", "christina", "elon", "poroshenko", "sean",
    "alibaba", "ebook", "kinect", "craigslist", "youtube",
)


def sql_list(values) -> str:
    """Render a tuple of strings as a SQL ``IN`` list (quotes doubled)."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
