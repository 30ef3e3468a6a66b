"""Given names and their short forms, as fixed values."""

# Short form -> given name.
NICKNAMES = {
    "al": "albert", "andy": "andrew", "barb": "barbara", "becky": "rebecca", "ben": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william",
    "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher", "chuck": "charles", "dan": "daniel", "danny": "daniel", "dave": "david",
    "deb": "deborah", "debbie": "deborah", "dick": "richard", "don": "donald", "drew": "andrew", "ed": "edward", "fran": "frances", "frank": "francis", "fred": "frederick",
    "greg": "gregory", "hank": "henry", "jack": "john", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph", "johnny": "john",
    "jon": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "larry": "lawrence", "liz": "elizabeth", "lou": "louis", "maggie": "margaret",
    "mandy": "amanda", "meg": "margaret", "mike": "michael", "nate": "nathaniel", "nat": "nathaniel", "ned": "edward", "nick": "nicholas", "pat": "patricia", "peggy": "margaret", "pete": "peter",
    "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel", "sandy": "sandra", "steve": "steven", "sue": "susan",
    "susie": "susan", "ted": "theodore", "terry": "terence", "theo": "theodore", "tim": "timothy", "toby": "tobias", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "vicky": "victoria", "vicki": "victoria", "vic": "victor",
    "wendi": "wendy", "will": "william", "zack": "zachary", "zach": "zachary",
}

# Given names.
GIVEN = {
    "alice", "amanda", "andrew", "angela", "anna", "anthony", "albert", "barbara", "benjamin", "brian", "carlos", "carol", "catherine", "charles", "christopher", "dana", "daniel", "david",
    "deborah", "diana", "donald", "edward", "elena", "elizabeth", "emeka", "emily", "faith", "frances", "francis", "frederick", "george", "grant", "gregory", "hannah", "hassan", "helen", "henry",
    "ingrid", "jacob", "james", "jane", "jason", "jeffrey", "jennifer", "jessica", "john", "jonathan", "jose", "joseph", "julia", "karen", "katherine", "kenji", "kenneth", "kevin", "laura",
    "lawrence", "linda", "lisa", "louis", "maria", "marisol", "margaret", "mark", "martin", "mary", "matthew", "may", "michael", "nancy", "nathaniel", "nicholas", "noor", "olaf", "olga",
    "olivia", "patricia", "paul", "peter", "philip", "priya", "quentin", "rachel", "raymond", "rebecca", "richard", "robert", "ronald", "rose", "ruth", "samuel", "sandra", "sarah", "scott",
    "sharon", "stephen", "steven", "susan", "terence", "theodore", "theresa", "thomas", "timothy", "tobias", "ulrich", "vera", "victor", "victoria", "walter", "wendy", "william", "xenia",
    "yolanda", "zachary",
}

# Given names that are also common words.
AMBIGUOUS = {"bill", "dick", "don", "drew", "faith", "frank", "grant", "jack", "mark", "may", "pat", "ray", "rich", "rob", "rose", "sue", "will", "nick", "al", "ed", "lou", "sandy", "scott", "martin", "nat"}

TITLES = {"mr", "mrs", "ms", "mx", "dr", "miss", "prof", "professor", "sir", "madam"}
