"""Text analysis as Column expressions (keyword contract, SURVEY 2.4.1).

Token = maximal run of letters and digits of any script in ``lower(text)``; the
position of a token is its 0-based index over all tokens (stop words count for
distance but are never postings). No stemming.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# The English list of Spark's StopWordsRemover, in its order.
_LISTED = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd "
    "you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't "
    "won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's "
    "ought that's there's what's when's where's who's why's would"
)

# Cut like any text, so that the parts of "don't" or "they'll" are stop words too.
STOP_WORDS = tuple(dict.fromkeys(re.findall("[a-z0-9]+", _LISTED)))


def tokens(text) -> Column:
    """ARRAY<STRING> of all tokens of ``lower(text)`` in order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN_PATTERN})"), 1)


def stop_word_array() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def is_stop_word(term) -> Column:
    c = F.col(term) if isinstance(term, str) else term
    return F.array_contains(stop_word_array(), c)
