"""Words that identifiers and paths are made of: frequent ones of program texts, and some of German, French and Spanish without accents."""

WORDS = """
return import this name class def error from python false value with true for self module the type none and not when else pass that encoding only file
except raise try used all list info are get init string decode default encode function can will returns len object there first check set text should
which use exception base create must while input also append make stream elif table attribute have call line errors called break str code these other
may but after has method codec decoding some args each sys argument open join like one format then does start current read isinstance number using
main more reader test was int data note character new bytes any add otherwise path case dict exit end here mapping remove since replace close same
find writer write given before print decoder empty next strict because they support into result final methods already encoder codecs index split time
incremental its cannot range non functions instance optional version don values handle instead repr continue del names message see streamreader
streamwriter found update getregentry tuple without parse encodings match last invalid arguments org than need copy needed most where specified source
both always key either returned implemented items user map been output out lines hasattr generated assert finally doesn two unicode mode parser
available written single them you count example passed run possible raised order just stop command level context strings such defined clear size
insert types windows objects getattr contains system change following compile between filename event build standard warning startswith state strip
implementation done super files want process calls until what characters max sequence whether being about part ignore buffer classes msg back header
search length could added another avoid different right multiple convert special item exists group directly based unknown control once simple frame
uses allow interface now through internal even idle issue defaults helper raises long valid calling left com pop would override protocol work help exc
global lower original information keys their specific created loop entry parent load charmap top attributes subclass running containing extend flag
compatibility reset property way yield over too future keep currently sorted ascii never delete stack itself zero least contain content means full
above provided dictionary removed func instances runtime platform binary still required expected exceptions skip block modules utf kwargs cls
copyright traceback point common show second store window flags bit nothing directory sort were complete sure space access gencodec below lambda
reference isn parameter keyword those idlelib integer sub register constructor extra named https during including library bool closed root many useful
stderr previous syntax supported trailing normal doc verbosity how float warnings options enter form stdout present arg within prefix unittest include
starting wrapper local save extension look variable via unless wait again provides generic old exist ensure additional later escape details xab
actually tkinter thread handler wrap cache takes necessary generate xbb operation option per well might callable iter supports socket entries place
setting regular mark iteration behavior spec usage raw display builtin built newline provide classmethod alias dir http returning assume shell
requires pair byte enumerate anything made warn possibly missing endswith define collections accept obj pos reading needs variables real double
allowed initial unix globals generator min whitespace numbers every existing handling free xac changes tuples limit lookup know offset failed
equivalent contents safe makes times down pack bind fast off prevent connection constants position cases allows rstrip readline stdin parts title exec
longer similar reverse send server buffered char style fail includes debug results select chars initialize action events lemburg corresponding however
subprocess correct label negative changed something caller around button writing our maximum won ignored deprecated abc section lineno cancel
implement partial xdc xad got appropriate messages public unsupported timeout getitem according namespace sets underlying determine status total take
leading indent program callback xdf xfc release subclasses cause very happen bound target encoded probably matching really editor config modified
specify custom iterable automatically val functools tree lists word package representation less fill representing width address spaces side meaning
absolute versions interrupt relative arbitrary parsing expand argv enum xeb toplevel date location backwards various though private element parameters
known comment sep apply backward script xae xfa own flush reserved equal win beginning starts basic gets specifies implements dirname err maybe active
xed xee leave actual fails bytearray rather async tell view builtins slots separate body exactly fields num xbd xfb yet meta compare matches mod
adding keyboard better testing hook separator expression iso rest software three description author xea stored html execution hash abstract elements
occurs explicitly bad everything seconds upper seen passing move loader headers xef transfer related extract lock algorithm followed compatible zip
client factory depending groups references your documentation intended bpo likely digits signal usually turn column htest menu closing environment
fileno token chain iterator filter dialog quote broken unexpected words adds particular recursive pattern enough bugs works doing positive received
blocking immediately proxy under enable shared effect difference resource general pairs complex deprecation request checking extended extensions
report reason field remaining simply let able indicates converted restore wrapped descriptor indicate foo shutdown processing charset quoted xcd xda
nested imports tag pipe much inside reduce tests due qualname interpreter short memory permission readable modify paths updated bits handles supplied
creating etc fallback cancelled xff widget xbc focus associated represents configure bin locals follow reversed creates setattr itertools plus link
manager plain best conversion appear force big looking execute xbf blank email xcb xce geometry perform normally decimal threading coroutine discard
registered imported child translate seek loaded mac considered making formatted setup resulting outside others require attempt had application binding
xaf deleted statement taken usr cmd maxsize null executable determined operations fixed sum environ saved catch working entire why gives checked
addition latin step explicit derived didn res stat put filenames tabs transport selection compiled becomes defines www memoryview signature member
await attr stuff whole parsed therefore trying registry staticmethod looks small good auto sig creation thing clean identity high aren replaced
disable wrong structure cached importlib members xdb xaa xec large represent checks compute dummy overflow queue thus fix overridden handled consider
dump counter normalize happens numeric against purpose sent errno magic posix blocks connect unique tab height xcf xba xca bootstrap prior rights
recursively desired please selected basename vars calculate omitted integers exact definition follows together printed begin literal newlines array
disabled did quit ends delay previously node task properly runs multibyte give popen systems chunk log splitlines setdefault construct pickle
specification tools isfile ext isdir issues separated comments detect round docs struct little threads typically whose validate random opening amount
ready recursion opened treat multibytecodec examples inspect destroy started xcc xbe compiler feature accepted included things param startup font
rules indentation commands encountered abort several fall assumed resolve greater recent treated indicating formatting away eval bug deal boolean
functionality interactive proper soon printing row weakref subsequent accepts partition argparse suffix host port background addr executed andre marc
maps getcodec chang perky shik mbc browser become writable marker mutable bases important directories temporary tries darwin env direct debugging
correctly docstring points stacklevel reasons operator lstrip suitable condition kind occur policy pre seq bottom bar suppress params multi finished
abspath mal displayed ufffe described pending origin early eof ending requested external issubclass neither depends anyway produce padding unchanged
latter platforms buf inner guess prompt asyncio slice quotes printable identifier unregister sequences hide initialized frozenset metaclass inherit
shouldn slow incorrect mixin color reached util marked edit going components shift locale faster stripped push ord sense often few appended figure
response prefer having txt undo getvalue controls fully upon sometimes unpack hack caught problem especially deque keywords colon proto sendfile
ordered domain specifying tags xdd xfd conf record frozen purposes contextlib var verbose easy union copied hard kwds terminated incomplete foundation
apple major whenever alternative users nor helpers twice sentinel unable logic separators namedtuple comparison generally performance decoded bufsize
alive escaped processed linux formatter tasks protocols console executing trace head selector appears remote finish completion fetch settings certain
mechanism orig dot highlight master query guaranteed four successful install causes streams prev minimum container typing notes rename longest
compressed subset listed replacement box behaviour getstate utility further digit fit abs interpreted hold account undefined switch optionally cover
care importing walk expect successfully invoke nargs wrapping collect opts waiting lost sock optimization seems convenience retrieve refer rfind white
bell occurred assuming tmp larger buffering semantics speed chr pathname unused component indices failure allowing cycle decorator resolution skipped
says ignoring database giving ints leaving tail minus properties truncate identical taking subject getting triple feed fspath nbytes wraps github
cursor framework widgets choices col nonlocal depth verify cleanup hostname family completed post terminate assigned remember duplicate normcase
inherited fullname codes track click toggle canvas theme consume writes getframe setitem colors floating mappings ttk forward limited individual
handlers pure universal splitext configuration drop older wants mixed someone consists compared remains conditions routine decide kept reads disk
whatever problems ones dispatch expanded attrs modification tokenize audit timer native perhaps getopt filesystem und der die das nicht ein eine mit
auf fur sich werden haben wir ihr uber nach auch schon immer wieder gegen zwischen wahrend strasse wasser arbeit leben freiheit moglichkeit
gesellschaft entwicklung verantwortung wirtschaft wissenschaft geschichte regierung verwaltung versicherung zeitung bedeutung verbindung einrichtung
schlecht freundlich endlich wirklich naturlich sprache schule kirche kinder menschen sicherheit gesundheit krankheit schaft keit heit lich ung les des
une dans pour que qui sur avec pas nous vous leur cette comme mais tout faire aussi bien apres avant toujours quelque maison travail monde temps jour
question ouverture connaissance developpement gouvernement nation beaucoup nouveau lumiere heureux mieux los las una por con para como mas pero este
esta todo hacer tambien siempre despues antes trabajo mundo tiempo ciudad nacion informacion desarrollo gobierno conocimiento mente dad cion
rapidamente nuevo bueno mismo donde cuando porque nuestro persona
""".split()
