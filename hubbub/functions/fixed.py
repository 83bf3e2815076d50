"""Results depend on exactly these words, patterns and limits."""

STOPWORDS = (
    "a an and are as at be been but by can cant did do does dont for from get got had has have he her "
    "him his how i if in is it its just like me my no not now of on one or our out she should so some "
    "than that the their them then there these they this to too up us very was we were what when where "
    "which who why will with would you your yours yeah yes yep nah nope ok okay omg pls plz thanks "
    "bro bruh man dude guys chat stream streamer twitch"
).split()
THEME_STOPWORDS = "the and for you this that with but not are was или что как это там тут все они она его ещё еще".split()
SECTIONS = (
    ("audience_answer", "Audience answers"),
    ("unanswered_question", "Questions chat asked that were never answered"),
    ("reaction", "Reaction waves"),
    ("warning", "Warnings"),
    ("clip", "Clip candidates"),
    ("theme", "Recurring themes"),
)
COSINES = (0.30, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.80)
WH_WORDS = "who whos what whats when whens where wheres why whys how hows which".split()
AUX_WORDS = "is are do does did can could would should will has have was were any anyone".split()
LAUGHTER = r"^(?:l+o+l+(?:ol)*|lmf?ao|rofl|kekw?|xd+|(?:a?ha){2,}h?|(?:he){2,}|(?:а?ха){2,}х?|(?:хе){2,})$"
WORDISH = r"[0-9A-Za-zÀ-ɏЀ-ӿ]"
LINK = r"(?i)(?:https?://|www\.)?(\b[a-z0-9][a-z0-9-]{0,30}(?:\.[a-z0-9-]{1,30})*\.(?:gg|com|net|io|tv|me|xyz|link|shop|ly|app|co|org)\b)(?:/\S*)?"
INJECTION = (
    r"(?i)\b(ignore (?:all |the )?(?:previous|prior|above|earlier)|disregard (?:all |the )?(?:previous|prior|above)|you are (?:now|a|an) \w+|system prompt|new instructions?|"
    r"pretend (?:you|to be)|act as (?:a|an|if)|jailbreak|reveal (?:your|the) (?:prompt|instructions|system)|output (?:your|the) (?:prompt|instructions)|forget (?:everything|all|your)|</?(?:system|instruction|prompt)>)"
)
EMPTY_KEY, REACTION_KEY = "∅", "∎reaction"
PREFIX_CHARS, MIN_PREFIX, MIN_TOKEN = 4, 4, 3
TILE_MS, BUCKET_MS, ANSWER_MS, COORDINATED_MS = 60_000, 10_000, 120_000, 30_000
