"""Suffixes of more than one label under which names are registered, in the notation of public suffix lists.

``*`` stands for any one label, ``!`` marks a name that is registered although a wildcard
covers it.  A list of common ones; for a whole crawl pass a complete list as a table.
"""

_SECOND = {
    "uk": "co org ac gov ltd me net nhs plc police sch", "au": "com net org edu gov asn id", "jp": "co ac ad ed go gr lg ne or", "br": "com net org gov edu blog art eco ind inf jus leg mil tv",
    "nz": "co net org ac govt geek gen iwi kiwi maori school cri health mil", "za": "co net org ac gov web law school nom", "in": "co net org firm gen ind ac edu res gov mil nic", "cn": "com net org ac edu gov mil",
    "tw": "com net org edu gov mil idv game club", "hk": "com net org edu gov idv", "sg": "com net org edu gov per", "my": "com net org edu gov mil name", "th": "co ac go in mi net or", "id": "co ac go or web sch my mil net desa",
    "kr": "co ac go ne or re pe es hs kg ms sc", "tr": "com net org edu gov av bel biz dr gen info k12 name pol tel tv web", "mx": "com net org edu gob", "ar": "com net org edu gob gov int mil tur", "co": "com net org edu gov mil nom",
    "pe": "com net org edu gob mil nom", "ve": "co com net org edu gob info web", "ec": "com net org edu gob gov fin info med", "uy": "com net org edu gub mil", "py": "com net org edu gov coop", "bo": "com net org edu gob int", "cr": "co ac ed fi go or sa",
    "il": "co ac org net gov k12 muni idf", "sa": "com net org edu gov med pub sch", "ae": "co net org ac gov mil sch", "eg": "com net org edu gov eun mil name sci", "ma": "co net org ac gov press", "ng": "com net org edu gov mil name sch i", "ke": "co ac go info me mobi ne or sc",
    "gh": "com org edu gov mil", "tz": "co ac go hotel info me mil mobi ne or sc tv", "ug": "co ac go com ne or org sc", "zw": "co ac org gov mil", "pk": "com net org edu gov fam gob gok gon gop gos biz web", "bd": "com net org edu gov ac mil", "lk": "com net org edu gov ac assn grp hotel int ltd ngo sch soc web",
    "np": "com net org edu gov mil", "ph": "com net org edu gov mil ngo i", "vn": "com net org edu gov ac biz health info int name pro", "kh": "com net org edu gov mil per", "ru": "com org net pp msk spb", "ua": "com net org edu gov in kiev kyiv lviv odessa kharkov dp", "by": "com gov mil of", "kz": "com net org edu gov mil",
    "pl": "com net org edu gov info biz waw krakow wroc", "hu": "co org info sport tm", "ro": "com org info firm nom nt rec store tm www arts", "gr": "com net org edu gov", "cy": "com net org ac gov biz ekloges ltd parliament press pro tm", "pt": "com net org edu gov int nome publ", "es": "com org gob edu nom",
    "it": "edu gov", "fr": "asso com gouv nom prd tm", "at": "co ac gv or", "be": "ac", "se": "ac org pp tm", "no": "co kommune stat priv", "fi": "aland", "is": "com net org edu gov int", "mt": "com net org edu", "lv": "com net org edu gov asn conf id mil",
}
_OTHERS = (
    "github.io gitlab.io gitbook.io readthedocs.io herokuapp.com netlify.app vercel.app pages.dev workers.dev web.app firebaseapp.com appspot.com azurewebsites.net cloudfront.net onrender.com fly.dev surge.sh "
    "blogspot.com wordpress.com tumblr.com weebly.com wixsite.com squarespace.com typepad.com livejournal.com substack.com ghost.io neocities.org bitbucket.io glitch.me repl.co now.sh "
    "eu.org us.com uk.com de.com jpn.com cn.com br.com sa.com za.com gb.net uk.net se.net hu.net "
    "*.ck !www.ck *.er *.fk *.jm *.kh *.mm *.np *.pg *.bd *.kawasaki.jp !city.kawasaki.jp *.kobe.jp !city.kobe.jp *.nagoya.jp !city.nagoya.jp *.sapporo.jp !city.sapporo.jp *.sendai.jp !city.sendai.jp *.yokohama.jp !city.yokohama.jp"
)
SUFFIXES = tuple(sorted({f"{a}.{b}" for b, names in _SECOND.items() for a in names.split()} | set(_OTHERS.split())))
