"""The word lists that the SQL of the queries shares with the library: a changed entry would pass there unseen."""

import hashlib
import json

from mnemospark.functions import text as T


def test_fixed_values_are_as_they_were_read():
    values = [T.STOPWORDS, T.LEMMAS, T.ALIASES, T.SUFFIXES, T.TOKEN, T.ENTITIES, T.DOUBLES]
    assert hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest() == "1612bec82d9486173ee401640c4b961ee05ba071ed42f140dd82fe47af3130d5"
