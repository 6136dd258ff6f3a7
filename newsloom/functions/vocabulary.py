"""Term lists of the rule operators. News vocabulary by label, first label that matches wins."""

CATEGORIES = {
    "conflict": ["war", "military", "missile", "army", "attack", "strike", "troops", "combat", "weapons", "defense", "ceasefire", "invasion", "casualt", "airstrikes", "shelling", "armed conflict", "insurgent", "guerrilla"],
    "diplomacy": ["treaty", "diplomatic summit", "peace summit", "g7 summit", "g20 summit", "nato summit", "bilateral summit", "leaders summit", "summit talks", "ambassador", "sanction", "diplomat", "bilateral", "un [a-z0-9_]+", "united nations", "nato", "foreign minister", "consul", "envoy", "multilateral", "peacekeep"],
    "politics": ["election", "parliament", "congress", "president", "prime minister", "vote", "campaign", "senate", "legislation", "democrat", "republican", "cabinet", "referendum", "ballot", "impeach", "governor", "mayor"],
    "economics": ["inflation", "gdp", "interest rate", "central bank", "federal reserve", "currency", "trade deficit", "tariff", "recession", "debt", "monetary policy", "fiscal"],
    "markets": ["stocks", "nasdaq", "dow jones", "s&p", "yield", "bond", "shares", "market index", "equity", "rally", "sell-off", "ipo", "stock market"],
    "business": ["earnings", "quarterly revenue", "merger", "acquisition", "ceo", "layoffs", "startup", "funding", "antitrust", "profit", "revenue", "valuation", "venture capital", "private equity", "corporate", "shareholder", "dividend"],
    "technology": [
        "artificial intelligence", "machine learning", "deep learning", "neural network", "large language model", "generative ai", "chatbot", "ai model", "ai system", "reasoning model", "foundation model", "openai", "anthropic", "deepmind", "chatgpt", "claude", "gemini", "hugging face",
        "semiconductor", "chip", "processor", "gpu", "cpu", "fabrication", "lithograph", "transistor", "silicon", "wafer", "foundry",
        "software", "app", "application", "platform", "operating system", "browser", "firmware", "update", "patch", "version", "release", "beta", "developer", "api", "sdk", "open source",
        "smartphone", "laptop", "tablet", "wearable", "headset", "gadget", "device", "hardware", "robot", "drone", "autonomous", "self-driving", "ev battery", "electric vehicle",
        "cyber", "hacker", "ransomware", "malware", "data breach", "encryption", "quantum comput", "cloud computing", "data center", "5g", "6g", "broadband", "fiber optic", "satellite internet",
        "product launch", "launched", "launches", "launching", "unveils?", "announc[a-z0-9_]* new", "debuts?", "flagship", "next-gen", "cutting-edge", "breakthrough tech", "innovation", "tech giant", "tech company", "tech summit",
    ],
    "climate": ["climate", "wildfire", "flood", "hurricane", "tornado", "earthquake", "drought", "emissions", "temperature", "arctic", "storm", "tsunami", "typhoon", "cyclone", "landslide", "volcanic", "eruption", "heatwave", "monsoon"],
    "health": ["virus", "disease", "vaccine", "outbreak", "hospital", "health", "fda", "who [a-z0-9_]+", "pandemic", "medical", "cancer", "surgery", "clinical trial", "drug approv", "pharma", "therapeutic", "epidemic", "infection"],
    "law": ["supreme court", "judge", "verdict", "indictment", "lawsuit", "prosecutor", "trial", "court", "ruling", "plea", "attorney general", "legal", "sentence", "conviction", "acquit"],
    "science": ["telescope", "physics", "biology", "nasa", "astronomy", "discovery", "researchers", "species", "fossil", "genome", "crispr", "particle", "exoplanet", "mars", "moon", "space station", "satellite", "rocket", "launch vehicle", "orbit", "astrophys", "lab", "experiment", "scientific", "study finds", "study shows", "journal", "peer.review"],
    "environment": ["solar", "wind energy", "renewable", "nuclear", "oil price", "opec", "natural gas", "pipeline", "energy transition", "power grid", "electricity", "hydroelectric", "geothermal"],
    "sports": ["olympic", "world cup", "championship", "tournament", "match", "league", "medal", "athlete", "coach", "soccer", "football", "cricket", "tennis", "basketball", "baseball", "racing", "motorsport"],
    "culture": ["film", "movie", "album", "concert", "museum", "theater", "theatre", "award", "grammy", "oscar", "emmy", "festival", "exhibition", "novel", "book", "artist", "cultural", "heritage"],
}
SEVERITIES = {
    "critical": ["breaking", "urgent", "catastrophic", "declaration of war", "emergency declared", "mass casualty", "deadly earthquake"],
    "high": ["killed", "explosion", "crisis", "warning", "escalat", "assassination", "crash", "collapse", "threat"],
}
FRAMES = {
    "Causal & Environmental": ["rainfall", "monsoon", "climate", "geological", "weather", "natural"],
    "Human Impact & Casualties": ["death", "killed", "displaced", "homeless", "victim", "survivor", "toll"],
    "Government & Institutional Response": ["rescue", "army", "police", "shelter", "minister", "aid", "budget", "relief"],
    "Accountability & Governance": ["corruption", "drainage", "encroachment", "failure", "delay", "warning ignored", "negligence"],
    "Economic & Infrastructure Repercussions": ["highway", "bridge", "supply chain", "inflation", "trade", "billions", "loss"],
}
#: Event types and the patterns of each (fixed values); a pattern stands for whole words, in any case.
TAXONOMY = {
    "PRODUCT_LAUNCH": ["unveils?|launches?|launched|launching|debuts?|debuted|rolls? out|rolled out|introduces?|introduced", "now available|open for pre-orders?|hits the market|commercial availability", "unveiled new|reveals? new|announced its new"],
    "PRODUCT_RELEASE": ["releases?|released|releasing|ships?|shipped|shipping", r"version \d+|v\d+\.\d+|update \d+|general availability|GA", "available to download|now live|public beta|rollout"],
    "MODEL_RELEASE": ["llm|foundation model|weights|open weights|checkpoints?|model architecture", r"gpt[-\s]?[a-z0-9.]+|claude[-\s]?[a-z0-9.]+|gemini[-\s]?[a-z0-9.]+|llama[-\s]?[a-z0-9.]+|mistral|deepseek|gemma|qwen|phi[-\s]?[0-9]+", "releases model|launches model|open-sources? (?:model|weights)|fine-tuned model", "new ai model|vision-language model|multimodal model|reasoning model|frontier ai model"],
    "FEATURE_RELEASE": ["new feature|adds support for|now supports?|integration with|integrates?|functionality", "plug-?in|extension|capability|enhancement|update brings"],
    "COMPANY_ANNOUNCEMENT": ["press release|company announces|statement from|spokesperson said|official announcement", "ceo announces|unveiled at|keynote|developers conference|earnings call"],
    "RESEARCH_FINDING": ["researchers? (?:find|found|show|discover|publish|reveal)", "study (?:shows|finds|reveals|demonstrates|suggests|indicates)", "published in|peer-reviewed|journal|arxiv|clinical trial|paper shows"],
    "SCIENTIFIC_DISCOVERY": ["scientists? (?:discover|discovered|breakthrough|unearth|identify)", "new species|astronomers? detect|telescope captures|particle discovered|genome sequence", "scientific breakthrough|quantum breakthrough|fusion milestone"],
    "EXPERT_WARNING": ["warns?|warned|warning|caution|cautions|raises alarm|alarm bells", "threat of|danger of|existential risk|scientists warn|experts urge|catastrophic risk"],
    "FORECAST": ["predicts?|predicted|prediction|forecasts?|projected|projections?|outlook", "expected to|by 2026|by 2030|future of|will see|estimated to grow"],
    "POLICY": ["government policy|framework|guidelines?|national strategy|executive order", "white house|parliament|cabinet approves|ministry announces|action plan"],
    "REGULATION": ["regulators?|regulatory|antitrust|ftc|fcc|sec|doj|eu commission|dma|dsa", "compliance|mandate|rules? on|enforcement action|oversight committee"],
    "LAW": ["legislation|bill|lawmakers? pass|enacted|statute|act of parliament|signed into law", "ai act|chips act|treaty ratified|constitution"],
    "ELECTION": ["elections?|ballots?|polls?|voters?|presidential race|parliamentary vote|referendum"],
    "APPOINTMENT": ["appoints?|appointed|steps down|resigns?|named as ceo|new director|cabinet reshuffle"],
    "DIPLOMATIC_DEVELOPMENT": ["summit|bilateral|talks|treaty|envoy|ambassador|sanctions?|accord|diplomats?"],
    "CONFLICT": ["airstrikes?|military|missiles?|shelling|offensive|truce|ceasefire|troops?|clashes?|war"],
    "DISASTER": ["earthquake|floods?|flooding|cyclone|hurricane|typhoon|wildfires?|landslide|tsunami|volcano", "magnitude|richter|death toll|casualties|evacuation|rescue operations?"],
    "MARKET_MOVE": ["shares? (?:surge|plunge|drop|rally)|stock price|nasdaq|s&p|ipo|market cap"],
    "BUSINESS_DEAL": ["partnership|strategic alliance|joint venture|contract signed|multi-million dollar deal"],
    "ACQUISITION": ["acquires?|acquired|acquisition|buys? out|takeover|merger|in talks to buy"],
    "COURT_DECISION": ["supreme court|judge rules|verdict|lawsuit|injunction|appeals court|settlement reached"],
    "INVESTIGATION": ["inquiry|probe|investigation|inspectors?|whistleblower|audit finds|subpoena"],
    "REPORT": ["report finds|investigative report|annual review|dossier|comprehensive report"],
    "ANALYSIS": ["analysis|deep dive|why it matters|behind the scenes|perspective|explainer"],
    "OPINION": ["opinion|editorial|columnist|commentary|op-ed|viewpoint|perspectives?"],
}
#: Titles of articles that discuss a product (fixed values).
DISCUSSION = ["how to|review of|hands-on with|tips for|comparison between|why .* is (?:bad|good|failing|overrated)", "what we know about|rumors?|leaks? suggest|speculation|might feature", "interview with|profile of|history of"]
HAZARDS = {"conflict": 0.72, "disasters": 0.68, "climate": 0.58, "politics": 0.42, "economics": 0.38, "health": 0.45, "science": 0.20, "technology": 0.25}
HAZARD_OTHER = 0.30

#: Words of the synthetic fixtures, for the registered queries: invented prose holds no news words.
FIXTURE_CATEGORIES = {"conflict": ["thtion", "thread"], "climate": ["attion", "thand"], "science": ["ertion", "therh"], "law": ["honer", "stand"]}
FIXTURE_SEVERITIES = {"critical": ["edthe", "thentst"], "high": ["the", "der", "la"]}
FIXTURE_FRAMES = {"Causal & Environmental": ["the", "of"], "Human Impact & Casualties": ["der", "les"], "Government & Institutional Response": ["que", "los"]}
#: Event types of the synthetic categories.
FIXTURE_TYPES = {"conflict": "CONFLICT", "climate": "DISASTER", "science": "RESEARCH_FINDING", "law": "OPINION"}
FIXTURE_TOKENS = ["thtion", "attion", "ertion"]
FIXTURE_ENTITIES = ["thtion", "stand"]
FIXTURE_EXPECTED, FIXTURE_DEMOTED = ["RESEARCH_FINDING", "DISASTER"], ["OPINION"]
STOP = ["the", "and", "for", "with", "that", "this", "from", "was", "are"]

#: Wire services by what names them; upper-case initials are told from words by case.
WIRES = {
    "Associated Press": r"\bAP\b|(?i:associated press|ap news)",
    "Reuters": r"(?i:\breuters\b)",
    "Agence France-Presse": r"\bAFP\b|(?i:agence france-presse)",
    "Bloomberg": r"(?i:\bbloomberg\b)",
    "PR Newswire": r"(?i:pr newswire|prnewswire)",
    "Business Wire": r"(?i:business wire)",
}
FIXTURE_WIRES = {"First": r"\bThe\b|(?i:attion)", "Second": r"(?i:\bder\b)"}

#: Source hierarchy: what a type equals, an address or a name contains, in this order.
HIERARCHY = {
    "PRIMARY SOURCE": (["manual", "official"], [".gov", ".mil", ".int"], ["ministry", "department of", "press release", "treaty", "white house", "parliament"]),
    "SCIENTIFIC_TECHNICAL": ([], [".edu"], ["university", "institute", "journal", "usgs", "nasa", "copernicus", "nature", "meteorological"]),
    "INDEPENDENT_NEWS": (["rss", "gdelt", "newsapi"], [], ["reuters", "ap", "bbc", "deutsche welle", "al jazeera", "guardian", "npr"]),
    "PUBLIC_SIGNAL": (["social"], [], ["twitter", "reddit", "telegram", "social"]),
}

#: Words that signal what a question is after.
INTENT_SIGNALS = {
    "forecast": ["will", "predict", "prediction", "forecast", "future of", "what happens next", "what will happen", "outlook", "projections?", "by 2026", "by 2030"],
    "fact_check": ["is this (?:claim )?true", "is it true", "fact[ -]check", "verify if", "did .* really", "is .* fake", "debunk", "claim:[a-z0-9_]+"],
    "launch": ["product launches?", "launch", "launched", "launching", "unveils?", "debuts?", "releases? new", "released new", "ships? new", "commercial availability", "new devices?", "new hardware"],
    "model": ["model releases?", "new (?:ai )?models?", "llm releases?", "weights?", "foundation model", "checkpoints?", "gpt", "claude", "gemini", "llama", "mistral", "deepseek"],
    "product": ["product", "products", "devices?", "apps?", "features?", "tools?"],
    "fresh": ["new", "latest", "recent"],
    "research": ["scientists? (?:discover(?:ed)?)", "scientific discovery", "discoveries", "researchers? (?:found|find|publish(?:ed)?)", "(?:new )?stud(?:y|ies)", "study findings?", "research findings?", "clinical trial", "breakthrough"],
    "court": ["court", "trial", "verdict", "homicide trial", "sentencing", "indictment", "lawsuit", "judge ruled", "guilty", "acquitted", "convicted", "plea", "hearing"],
    "cause": ["what caused", "why did", "cause of", "root cause", "how did .* happen", "reasons? for"],
    "disaster": ["earthquake", "floods?", "flooding", "cyclone", "hurricane", "typhoon", "tsunami", "wildfire", "landslide"],
    "policy": ["regulat[a-z0-9_]*", "policy", "policies", "law", "laws", "legislation", "act of", "ftc", "doj", "antitrust", "compliance", "enforcement"],
    "business": ["business developments?", "deals?", "acquisitions?", "merger", "earnings", "stocks?", "nasdaq", "market moves?"],
    "history": ["history of", "historical role", "historical background", "historical figure", "historical context", "history"],
    "timeline": ["timeline", "chronology", "evolution of", "what came before"],
    "overview": ["latest (?:ai )?technology", "latest tech news", "latest news", "world news", "tech overview", "technology news", "industry developments?"],
    "short_overview": ["latest", "news", "technology", "tech", "ai"],
    "now": ["latest", "recent", "updates?", "today", "now"],
}
#: Words of the synthetic conversations for some of the signals.
FIXTURE_SIGNALS = {"forecast": ["thtion"], "model": ["attion"], "launch": ["ertion", "stand"], "cause": ["honer"], "history": ["thand"], "policy": ["the"], "now": ["of", "der"]}

#: Words of a question that say nothing of its subject (fixed values).
QUESTION_STOP = [
    "what", "when", "where", "why", "how", "which", "who", "whom", "whose", "with", "from", "this", "that", "these", "those", "there", "their", "have", "were", "been", "about", "tell", "does", "will", "would", "could",
    "should", "is", "are", "was", "the", "and", "for", "any", "some", "happened", "occurred", "happening", "latest", "recent", "updates", "update", "news", "reports", "report", "finding", "findings", "study", "studies",
    "survey", "surveys", "explain", "explains", "detail", "details", "matter", "matters", "happen", "happens", "mean", "means", "say", "says", "give", "gives", "tells", "show", "shows", "find", "finds", "overview",
    "summary", "comprehensive", "right", "now", "today", "currently", "moment", "momentary",
]
#: Short tokens that name a subject all the same (fixed values).
SHORT_TOKENS = ["ai", "eu", "us", "uk", "un", "ev", "5g", "6g", "os", "vr", "ar", "ip", "g7", "g8", "pm", "fm", "pr"]
#: What to look for besides when a question holds the key (fixed values).
CONCEPTS = {
    "ai": ["artificial intelligence", "machine learning", "neural network", "llm", "deep learning", "model launch", "reasoning"],
    "technology": ["software", "hardware", "semiconductor", "product launch", "innovation", "computing"],
    "tech": ["software", "hardware", "semiconductor", "product launch", "innovation", "computing"],
    "launch": ["product launch", "unveiled", "debuted", "released", "announced"],
    "launches": ["product launch", "unveiled", "debuted", "released", "announced"],
    "japan": ["tokyo", "fukushima", "seismic", "japan meteorological agency"],
    "flood": ["rainfall", "monsoon", "river overflow", "landslide", "drainage", "infrastructure", "evacuation"],
    "flooding": ["rainfall", "monsoon", "river overflow", "landslide", "drainage", "infrastructure", "evacuation"],
    "quake": ["fault line", "aftershocks", "epicenter", "casualties", "structural damage", "seismic"],
    "earthquake": ["fault line", "aftershocks", "epicenter", "casualties", "structural damage", "seismic"],
    "cyclone": ["wind speed", "storm surge", "landfall", "evacuation", "coastal warning"],
    "hurricane": ["wind speed", "storm surge", "landfall", "evacuation", "coastal warning"],
    "typhoon": ["wind speed", "storm surge", "landfall", "evacuation", "coastal warning"],
    "war": ["ceasefire", "artillery", "territorial control", "diplomatic talks", "civilian casualties", "sanctions"],
    "conflict": ["ceasefire", "artillery", "territorial control", "diplomatic talks", "civilian casualties", "sanctions"],
    "election": ["turnout", "voting", "coalition", "ballot", "parliament", "campaign finance"],
    "trial": ["indictment", "prosecution", "testimony", "verdict", "defense counsel", "evidence"],
    "economy": ["inflation", "interest rates", "central bank", "gdp growth", "trade balance", "employment"],
    "tariff": ["import duties", "trade deficit", "customs", "bilateral trade", "retaliatory measures"],
    "unity": ["united", "unification", "integration", "solidarity", "european union", "eu"],
    "united": ["unity", "unification", "integration", "solidarity"],
    "europe": ["european", "eu", "brussels"],
    "european": ["europe", "eu", "brussels"],
}
#: Words that are too common to tell verified claims by (fixed values).
PICTURE_STOP = [
    "what", "when", "where", "which", "who", "whom", "this", "that", "with", "from", "have", "has", "had", "were", "been", "about", "latest", "news", "update", "updates", "report", "reports", "findings", "explain", "detail",
    "details",
]
#: Title words by which an article answers a question of the intent, and what it counts with and without them (fixed values).
DIRECT = [
    ("PRODUCT_LAUNCH", [("unveils?|launches?|debuts?|releases?|announced (?:new|commercial)", 0.98), ("warns?|caution|risk|danger|threat|worried", 0.02)], 0.35),
    ("RESEARCH_FINDING", [("researchers?|scientists?|study|discovery|published|trial", 0.95)], 0.40),
    ("DISASTER_STATUS", [("earthquake|floods?|quake|cyclone|hurricane|disaster", 0.95)], 0.30),
    ("CAUSE", [("cause|reason|trigger|why|rainfall|fault|failure|investigation", 0.90)], 0.45),
]
#: Sources that a new store starts with: name, type, address, reliability, enabled (fixed values).
SOURCES = [
    ("BBC World News", "rss", "http://feeds.bbci.co.uk/news/world/rss.xml", 0.88, True),
    ("Al Jazeera English", "rss", "https://www.aljazeera.com/xml/rss/all.xml", 0.82, True),
    ("NPR News", "rss", "https://feeds.npr.org/1001/rss.xml", 0.85, True),
    ("The Guardian World", "rss", "https://www.theguardian.com/world/rss", 0.84, True),
    ("Deutsche Welle World", "rss", "https://rss.dw.com/rdf/rss-en-world", 0.86, True),
    ("GDELT Global Intelligence", "gdelt", None, 0.75, True),
    ("NewsAPI Top Headlines", "newsapi", None, 0.80, False),
    ("BBC Technology", "rss", "http://feeds.bbci.co.uk/news/technology/rss.xml", 0.88, True),
    ("The Guardian Technology", "rss", "https://www.theguardian.com/technology/rss", 0.84, True),
    ("BBC Science & Environment", "rss", "http://feeds.bbci.co.uk/news/science_and_environment/rss.xml", 0.88, True),
    ("The Guardian Science", "rss", "https://www.theguardian.com/science/rss", 0.84, True),
    ("BBC Business", "rss", "http://feeds.bbci.co.uk/news/business/rss.xml", 0.88, True),
    ("The Guardian Business", "rss", "https://www.theguardian.com/business/rss", 0.84, True),
]
