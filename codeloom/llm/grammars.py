"""Grammars of the languages, over the tokens of syntax.tokens."""

# Keywords stand for themselves; ID, NUM, STR and REGEX are classes, NLB is a line break before the token.
PYTHON = """
file <- (stmt / NL)* END
stmt <- compound / simple
simple <- small (';' small)* ';'? NL
small <- 'pass' / 'break' / 'continue' / 'return' exprs? / 'raise' (test ('from' test)?)? / 'global' ID (',' ID)* / 'nonlocal' ID (',' ID)* / 'del' exprs / 'assert' test (',' test)? / import / typealias / assign
typealias <- 'type' ID ('[' exprs ']')? '=' test
import <- 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* / 'from' ('.' / '...')* dotted? 'import' ('*' / '(' names ','? ')' / names)
names <- ID ('as' ID)? (',' ID ('as' ID)?)*
dotted <- ID ('.' ID)*
assign <- exprs (':' test ('=' rhs)? / augop rhs / ('=' rhs)*)
augop <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '**=' / '|=' / '&=' / '^=' / '<<=' / '>>=' / '@='
rhs <- 'yield' ('from' test / exprs?) / exprs
compound <- decorator* (class / 'async'? func) / if / while / 'async'? for / try / 'async'? with / match
decorator <- '@' test NL
class <- 'class' ID typeparams? ('(' args? ')')? ':' block
func <- 'def' ID typeparams? '(' params? ')' ('->' exprs)? ':' block
typeparams <- '[' exprs ']'
params <- param (',' param)* ','?
param <- '/' / ('*' / '**') (ID (':' test)?)? / ID (':' test)? ('=' test)?
block <- NL INDENT (stmt / NL)+ DEDENT / simple
if <- 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
while <- 'while' named ':' block ('else' ':' block)?
for <- 'for' targets 'in' exprs ':' block ('else' ':' block)?
try <- 'try' ':' block (('except' '*'? (exprs ('as' ID)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? / 'finally' ':' block)
with <- 'with' ('(' withitem (',' withitem)* ','? ')' ':' / withitem (',' withitem)* ':') block
withitem <- test ('as' star)?
match <- 'match' exprs ':' NL INDENT ('case' casepat ('if' named)? ':' block)+ DEDENT
casepat <- (!':' !'if' !NL (group / ANY))+
group <- '(' (!')' (group / ANY))* ')' / '[' (!']' (group / ANY))* ']' / '{' (!'}' (group / ANY))* '}'
targets <- star (',' star)* ','?
star <- '*'? bitor
exprs <- starred (',' starred)* ','?
starred <- '*' bitor / named
named <- ID ':=' test / test
test <- lambda / or ('if' or 'else' test)?
lambda <- 'lambda' lparams? ':' test
lparams <- lparam (',' lparam)* ','?
lparam <- '/' / ('*' / '**') ID? / ID ('=' test)?
or <- not (('and' / 'or') not)*
not <- 'not'* compare
compare <- bitor (('<' / '>' / '==' / '!=' / '<=' / '>=' / 'not' 'in' / 'in' / 'is' 'not' / 'is') bitor)*
bitor <- unary (('|' / '&' / '^' / '<<' / '>>' / '+' / '-' / '*' / '/' / '//' / '%' / '@') unary)*
unary <- ('+' / '-' / '~')* 'await'? postfix ('**' unary)?
postfix <- atom ('.' ID / '(' args? ')' / '[' slices ']')*
args <- arg (',' arg)* ','?
arg <- ID '=' test / '*' test / '**' test / named comp?
slices <- slice (',' slice)* ','?
slice <- starred? ':' test? (':' test?)? / starred
comp <- ('async'? 'for' targets 'in' or ('if' cond)*)+
cond <- lambda / or
atom <- '(' ('yield' ('from' test / exprs?) / starred comp / exprs)? ')' / '[' (starred comp / exprs)? ']' / '{' dict? '}' / STR+ / NUM / '...' / 'None' / 'True' / 'False' / ID / 'match' / 'case' / 'type'
dict <- (entry comp / entry (',' entry)* ','?) / (starred comp / exprs)
entry <- '**' bitor / test ':' test
"""

_JS = """
file <- stmt* END
end <- ';' / &'}' / NLB / &END
stmt <- block / ';' / 'import' import / 'export' export / decorators? class / func / TSDECL vardecl end / if / for / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';'? / try / switch / 'return' (!NLB expr)? end / 'throw' expr end / ('break' / 'continue') (!NLB ID)? end / 'debugger' end / !'let' !'const' ID ':' stmt / !'function' !'class' expr end
block <- '{' stmt* '}'
import <- STR end / '(' expr ')' tail end / '.' name tail end / TYPEWORD importlist 'from' STR ('with' object)? end / importlist 'from' STR ('with' object)? end
importlist <- ID (',' (named / '*' 'as' ID))? / named / '*' 'as' ID
named <- '{' (spec (',' spec)* ','?)? '}'
spec <- TYPEWORD (name / STR) ('as' name)? / (name / STR) ('as' (name / STR))?
export <- 'default' (class / func / assign end) / '*' ('as' name)? 'from' STR end / TYPEWORD? named ('from' STR)? end / '=' expr end / decorators? stmt
decorators <- ('@' lhs)+
class <- ABSTRACT? 'class' (!'extends' ID)? TPARAMS? ('extends' lhs TARGS?)? IMPLEMENTS? '{' member* '}'
member <- ';' / 'static' block / INDEXSIG / decorators? modifier* ('*' key / key) ('?' / '!')? (TPARAMS? params TRET? (block / end) / ANNOT? ('=' assign)? end)
modifier <- ('static' / 'async' / 'get' / 'set' / 'readonly' / 'public' / 'private' / 'protected' / 'abstract' / 'override' / 'declare') &(key / '*' / '[')
key <- name / STR / NUM / '[' assign ']' / '#' name
func <- 'async'? 'function' '*'? ID? TPARAMS? params TRET? (block / TSEND)
params <- '(' (param (',' param)* ','?)? ')'
param <- decorators? PMOD* '...'? binding '?'? ANNOT? ('=' assign)?
binding <- '{' (bprop (',' bprop)* ','?)? '}' / '[' (','* '...'? binding ('=' assign)? )* ','* ']' / ID / 'this'
bprop <- '...' ID / key ':' binding ('=' assign)? / ID ('=' assign)?
vardecl <- ('const' / 'let' / 'var') decl (',' decl)*
decl <- binding '!'? ANNOT? ('=' assign)?
if <- 'if' '(' expr ')' stmt ('else' stmt)?
for <- 'for' 'await'? '(' (vardecl? ';' expr? ';' expr? / expr ';' expr? ';' expr? / ('const' / 'let' / 'var') binding ('of' / 'in') expr / lhs ('of' / 'in') expr) ')' stmt
try <- 'try' block ('catch' ('(' binding ANNOT? ')')? block ('finally' block)? / 'finally' block)
switch <- 'switch' '(' expr ')' '{' (('case' expr / 'default') ':' stmt*)* '}'
expr <- assign (',' assign)*
assign <- 'async'? TPARAMS? (ID / params TRET?) '=>' (block / assign) / 'yield' '*'? (!NLB assign)? / lhs assignop assign / cond
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '|=' / '&=' / '^=' / '&&=' / '||=' / '??=' / '>' '>=' / '>' '>' '>='
cond <- binary ('?' assign ':' assign)?
binary <- unary (binop unary / TSAS)*
binop <- '+' / '-' / '*' / '/' / '%' / '**' / '==' / '!=' / '===' / '!==' / '<=' / '>=' / '<<' / '<' / '>' '>' '>' / '>' '>' / '>' / '&&' / '||' / '??' / '&' / '|' / '^' / 'instanceof' / 'in'
unary <- ('!' / '-' / '+' / '~' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await')* lhs (!NLB ('++' / '--'))?
lhs <- 'new'* primary tail
tail <- ('.' '#'? name / '?.' (name / '[' expr ']' / args) / '[' expr ']' / TARGS? args / !NLB BANG / STR)*
args <- '(' (arg (',' arg)* ','?)? ')'
arg <- '...'? assign
primary <- func / class / '(' expr ')' / '[' (','* arg)* ','* ']' / object / 'new' '.' ID / 'import' ('(' expr ')' / '.' ID) / 'super' / 'this' / 'null' / 'true' / 'false' / REGEX / STR / NUM / '#' ID / ID / JSX
object <- '{' (prop (',' prop)* ','?)? '}'
prop <- '...' assign / ('async' / 'get' / 'set')? '*'? key TPARAMS? params TRET? block / key ':' assign / ID ('=' assign)?
jsx <- '<' jname? jattr* ('/' '>' / '>' jchild* '<' '/' jname? '>')
jname <- name (('-' / '.' / ':') name)*
jattr <- '{' '...' assign '}' / jname ('=' (STR / '{' assign '}' / jsx))?
jchild <- jsx / '{' expr? '}' / '{' '...' assign '}' / !'<' !'{' !'}' ANY
name <- ID / KW
"""
_TS = """
tsdecl <- ABSTRACTX? ('declare'? (interface / typedef / enum / namespace / 'declare' stmt))
interface <- 'interface' ID tparams? ('extends' type (',' type)*)? objtype
typedef <- 'type' ID tparams? '=' type end
enum <- 'const'? 'enum' ID '{' (key ('=' assign)? (',' key ('=' assign)?)* ','?)? '}'
namespace <- ('namespace' / 'module' / 'global') (ID ('.' ID)* / STR)? block
tparams <- '<' tparam (',' tparam)* ','? '>'
tparam <- ('const' / 'in' / 'out')* ID ('extends' type)? ('=' type)?
targs <- '<' type (',' type)* '>'
annot <- ':' type
tret <- ':' ('asserts'? (ID / 'this') 'is' type / 'asserts' ID / type)
type <- union ('extends' union '?' type ':' type)?
union <- ('|' / '&')? tpost (('|' / '&') tpost)*
tpost <- ('keyof' / 'readonly' / 'unique' / 'typeof' / 'infer')* tprim (!NLB '[' type? ']')*
tprim <- 'abstract'? 'new'? tparams? '(' (tfparam (',' tfparam)* ','?)? ')' '=>' tret2 / '(' type ')' / '[' ('...'? (ID '?'? ':')? type '?'? (',' '...'? (ID '?'? ':')? type '?'?)* ','?)? ']' / objtype / STR / '-'? NUM / 'void' / 'null' / 'true' / 'false' / 'this' / 'import' '(' STR ')' ('.' ID)* targs? / ID ('.' name)* (!NLB targs)?
tret2 <- (ID / 'this') 'is' type / type
tfparam <- '...'? binding '?'? (':' type)?
objtype <- '{' (tmember (';' / ',' / &'}' / NLB))* '}'
tmember <- ('+' / '-')? 'readonly'? '[' ID ('in' type ('as' type)? / ':' type) ']' ('+' / '-')? '?'? (':' type)? / 'new'? tparams? tmparams tret? / ('get' / 'set' / 'readonly')? key '?'? (tparams? tmparams tret? / ':' type)?
tmparams <- '(' (tfparam (',' tfparam)* ','?)? ')'
indexsig <- modifier* '[' ID ':' type ']' annot end
tsas <- !NLB ('as' ('const' / type) / 'satisfies' type)
implements <- 'implements' type (',' type)*
"""


def script(types: bool, markup: bool) -> str:
    """The grammar of JavaScript, with types and markup where the extension allows them."""
    on = {"TSDECL": "tsdecl /", "TYPEWORD?": "'type'?", "TYPEWORD": "'type'", "ABSTRACT?": "'abstract'?", "TPARAMS?": "tparams?", "TARGS?": "targs?", "IMPLEMENTS?": "implements?", "INDEXSIG": "indexsig", "TRET?": "tret?", "ANNOT?": "annot?", "TSEND": "end", "PMOD*": "('public' / 'private' / 'protected' / 'readonly' / 'override')*", "TSAS": "tsas", "BANG": "'!'", "ABSTRACTX?": "'abstract'?"}
    text = _JS + (_TS if types else "")
    for k, v in on.items():
        text = text.replace(k, v if types else "" if k.endswith(("?", "*")) or k == "TSDECL" else "'\u0000'")
    return text.replace("/ JSX", "/ jsx" if markup else "/ '<' type '>' unary" if types else "")


_GO = """
file <- 'package' ID sep ('import' imports sep)* (decl sep)* END
sep <- ';'+ / NLB / &')' / &'}' / &END
imports <- (ID / '.')? STR / '(' ((ID / '.')? STR sep)* ')'
decl <- ';' / 'import' imports / vard / constd / typed / 'func' params? ID tparams? sig body?
vard <- 'var' ('(' (varspec sep)* ')' / varspec)
varspec <- ids (type ('=' exprs)? / '=' exprs)
constd <- 'const' ('(' (constspec sep)* ')' / constspec)
constspec <- ids (!NLB type? '=' exprs)?
typed <- 'type' ('(' (typespec sep)* ')' / typespec)
typespec <- ID tparams? '='? type
tparams <- '[' ids constraint (',' ids constraint)* ','? ']'
constraint <- '~'? type ('|' '~'? type)*
ids <- ID (',' ID)*
sig <- params (!NLB (params / type))?
params <- '(' (param (',' param)* (',' / !NLB))? ')'
param <- ID '...'? type / '...' type / type
type <- ID ('.' ID)? (!NLB '[' type (',' type)* ']')? / '*' type / '[' ('...' / expr)? ']' type / 'map' '[' type ']' type / 'chan' ('<' '-')? type / '<' '-' 'chan' type / 'func' sig / struct / interface / '(' type ')'
struct <- 'struct' '{' (field sep)* '}'
field <- (ids !NLB type / '*'? ID ('.' ID)? (!NLB '[' type (',' type)* ']')?) (!NLB STR)?
interface <- 'interface' '{' ((ID params (!NLB (params / type))? / constraint) sep)* '}'
body <- !NLB block
block <- '{' stmts '}'
stmts <- (';' / stmt sep)*
stmt <- vard / constd / typed / 'return' (!NLB exprs)? / if / for / switch / 'select' '{' (('case' simple / 'default') ':' stmts)* '}' / ('go' / 'defer') expr / 'goto' ID / 'fallthrough' / ('break' / 'continue') (!NLB ID)? / block / ID ':' (!'}' stmt)? / simple
if <- 'if' (simpleH? ';')? exprH body (!NLB 'else' (if / body))?
for <- 'for' (simpleH? ';' exprH? ';' simpleH? / (exprsH (':=' / '='))? 'range' exprH / exprH)? body
switch <- 'switch' (simpleH? ';')? simpleH? !NLB '{' (('case' label (',' label)* / 'default') ':' stmts)* '}'
label <- type &(',' / ':') / expr
assignop <- ':=' / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&' '^='
binop <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<' / '<' / '>' '>' / '>' / '+' / '-' / '*' / '/' / '%' / '&' '^' / '&' / '|' / '^'
args <- '(' (arg (',' arg)* (',' / !NLB))? ')'
arg <- (type &(',' / ')') / expr) '...'?
literal <- '{' (item (',' item)* (',' / !NLB))? '}'
item <- (literal / expr) (':' (literal / expr))?
"""
# Expressions, and those of the heads of if, for and switch, where a brace after a name begins the body.
_GO_EXPR = """
simple@ <- exprs@ !NLB assignop exprs@ / expr@ !NLB ('++' / '--') / expr@
exprs@ <- expr@ (',' expr@)*
expr@ <- unary@ (!NLB binop unary@)*
unary@ <- ('+' / '-' / '!' / '^' / '*' / '&' / '<' '-')* postfix@
postfix@ <- primary (!NLB tail@)*
tail@ <- '.' (ID / '(' ('type' / type) ')') / '[' (expr? ':' expr? (':' expr)? / type (',' type)* ','? / expr) ']' / args LITERAL
"""
GO = _GO + _GO_EXPR.replace("@", "").replace("LITERAL", "/ literal") + _GO_EXPR.replace("@", "H").replace(" LITERAL", "") + """
primary <- NUM / STR / 'func' sig body / ('[' ('...' / expr)? ']' type / 'map' '[' type ']' type / struct) literal? / 'chan' type / interface / '(' expr ')' / '(' type ')' / ID
"""
_RUST = """
file <- inner item* END
inner <- ('#' '!' '[' tree* ']')*
attr <- '#' '[' tree* ']'
tree <- '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / !')' !']' !'}' ANY
item <- ';' / attr* vis? (use / 'mod' ID (';' / '{' inner item* '}') / ('struct' / 'union') ID generics? where? (';' / '{' fields '}' / '(' (slot (',' slot)* ','?)? ')' where? ';') / 'enum' ID generics? where? '{' (variant (',' variant)* ','?)? '}' / 'unsafe'? 'trait' ID generics? (':' bounds)? where? '{' member* '}' / 'unsafe'? 'impl' generics? '!'? type ('for' type)? where? '{' inner member* '}' / 'static' 'mut'? ID ':' type ('=' expr)? ';' / 'extern' 'crate' ID ('as' ID)? ';' / 'unsafe'? 'extern' STR? '{' inner member* '}' / member0)
member <- attr* vis? member0
member0 <- 'type' ID generics? (':' bounds)? where? ('=' type)? where? ';' / 'const' ID ':' type ('=' expr)? ';' / 'static' 'mut'? ID ':' type ';' / fn / macrohead ID? ('{' tree* '}' / ('(' tree* ')' / '[' tree* ']') ';')
vis <- 'pub' ('(' 'in'? segment ('::' segment)* ')')?
use <- 'use' usetree ';'
usetree <- '::'? (segment '::')* ('*' / '{' (usetree (',' usetree)* ','?)? '}' / segment ('as' ID)?)
segment <- ID / 'crate'
fields <- (field (',' field)* ','?)?
field <- attr* vis? ID ':' type
slot <- attr* vis? type
variant <- attr* vis? ID ('{' fields '}' / '(' (slot (',' slot)* ','?)? ')')? ('=' expr)?
fn <- ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' ID generics? '(' (param (',' param)* ','?)? ')' ('->' type)? where? (block / ';')
param <- attr* ('&' LIFE? 'mut'? ID &(',' / ')') / pattern ':' ('...' / type) / 'mut'? ID / '...')
generics <- '<' (gparam (',' gparam)* ','?)? '>'
gparam <- attr* (LIFE (':' LIFE? ('+' LIFE)*)? / 'const' ID ':' type ('=' garg)? / ID (':' bounds?)? ('=' type)?)
where <- 'where' (wpred (',' wpred)* ','?)?
wpred <- LIFE ':' bounds? / ('for' generics)? type ':' bounds?
bounds <- bound ('+' bound)* '+'?
bound <- LIFE / '(' bound ')' / '?'? ('for' generics)? type
type <- ('impl' / 'dyn') bounds / ('&' / '&&') LIFE? 'mut'? type / '*' ('const' / 'mut') type / '[' type (';' expr)? ']' / '(' (type (',' type)* ','?)? ')' / '!' / ('for' generics)? ('unsafe' / 'extern' STR? / 'async')* 'fn' '(' ((ID ':')? type (',' (ID ':')? type)* (',' '...')? ','?)? ')' ('->' type)? / macrohead '(' tree* ')' / ('<' type ('as' type)? '>' '::')? '::'? tsegment ('::' tsegment)*
tsegment <- segment ('::'? gargs / '(' (type (',' type)* ','?)? ')' ('->' type)?)?
gargs <- '<' (garg (',' garg)* ','?)? '>'
garg <- LIFE / ID gargs? ('=' type / ':' bounds) / type / '-'? NUM / STR / block
macrohead <- '::'? segment ('::' segment)* '!' !'='
path <- ('<' type ('as' type)? '>' '::')? '::'? segment ('::' (gargs / segment))*
block <- '{' inner stmt* '}'
stmt <- ';' / attr* ('let' pattern (':' type)? ('=' expr ('else' block)?)? ';' / item / solid !'.' !'?' !'?.' / expr (';' / &'}'))
solid <- (LIFE ':')? (if / match / 'while' cond block / 'loop' block / 'for' pattern 'in' exprH block / ('unsafe' / 'const')? block)
if <- 'if' cond block ('else' (if / block))?
cond <- ('let' pattern '=' exprH / exprH) ('&&' ('let' pattern '=' exprH / exprH))*
match <- 'match' exprH '{' inner arm* '}'
arm <- attr* pattern ('if' cond)? '=>' (expr (',' / &'}') / block)
pattern <- '|'? pat ('|' pat)*
pat <- lit ('.' '.' ('=' / '.')? lit?)? / '.' '.' ('=' lit)? / ('&' / '&&') 'mut'? pat / '(' (pattern (',' pattern)* ','?)? ')' / '[' (pattern (',' pattern)* ','?)? ']' / ('ref' / 'mut')* ID !'::' !'(' !'{' !'!' ('@' pat)? / macrohead '(' tree* ')' / path ('(' (pattern (',' pattern)* ','?)? ')' / '{' (fpat (',' fpat)* ','?)? '}' / '.' '.' ('=' / '.')? (lit / path))?
fpat <- attr* ('.' '.' / ('ref' / 'mut')* (ID / NUM) (':' pattern)?)
lit <- '-'? NUM / STR
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '>' '>='
binop <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<' / '<' / '>' '>' / '>' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^'
tail <- '?.' (ID ('::' gargs)? / 'await' / NUM) / '?' / '??' / '.' !'.' (ID ('::' gargs)? / 'await' / NUM) / '(' (expr (',' expr)* ','?)? ')' / '[' expr ']'
init <- '{' (sinit (',' sinit)* ','?)? '}'
sinit <- attr* ('.' '.' expr? / (ID / NUM) (':' expr)?)
cparam <- attr* pat (':' type)?
"""
# Expressions, and those of the heads of if, while, for and match, where a brace after a name begins the body.
_RUST_EXPR = """
expr@ <- attr* range@ (assignop expr@)?
range@ <- '.' '.' '='? or@? / or@ ('.' '.' '='? or@?)?
or@ <- unary@ (binop unary@ / 'as' type)*
unary@ <- ('-' / '!' / '*' / ('&&' / '&') 'mut'?)* primary@ tail*
primary@ <- NUM / STR / 'return' expr@? / 'break' LIFE? expr@? / ('move' / 'async' / 'static')* ('||' / '|' (cparam (',' cparam)* ','?)? '|') ('->' type block / expr@) / 'async' 'move'? block / solid / '(' (expr (',' expr)* ','?)? ')' / '[' (expr (';' expr / (',' expr)* ','?))? ']' / macrohead ('(' tree* ')' / '[' tree* ']' / '{' tree* '}') / path INIT / ID LIFE?
"""
RUST = _RUST + _RUST_EXPR.replace("@", "").replace("INIT", "init?") + _RUST_EXPR.replace("@", "H").replace(" INIT", "")
JAVA = """
file <- (annots 'package' dotted ';')? (';' / 'import' 'static'? dotted ('.' '*')? ';')* (';' / type)* END
dotted <- ID ('.' ID)*
annots <- annot*
annot <- '@' !'interface' dotted ('(' (elem (',' elem)* ','?)? ')')?
elem <- ID '=' elemval / elemval
elemval <- '{' (elemval (',' elemval)*)? ','? '}' / annot / ternary
mods <- (annot / 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'sealed' / 'non' '-' 'sealed' / 'strictfp' / 'synchronized' / 'native' / 'transient' / 'volatile' / 'default')*
type <- mods (('class' / 'interface') ID tparams? clause* body / 'enum' ID clause* '{' (constant (',' constant)* ','?)? (';' member*)? '}' / 'record' ID tparams? '(' params? ')' clause* body / '@' 'interface' ID body)
clause <- ('extends' / ID) jtype (',' jtype)*
body <- '{' member* '}'
constant <- annots ID args? body?
member <- ';' / type / mods block / mods tparams? ID '(' params? ')' throws block / mods ID block / mods tparams? jtype ID '(' params? ')' dims throws (block / 'default' elemval ';' / ';') / mods jtype vars ';'
tparams <- '<' tparam (',' tparam)* '>'
tparam <- annots ID ('extends' jtype ('&' jtype)*)?
throws <- ('throws' jtype (',' jtype)*)?
params <- param (',' param)*
param <- mods jtype '...'? (ID ('.' ID)* dims)
dims <- ('[' ']')*
jtype <- annots ID targs? ('.' annots ID targs?)* dims
targs <- '<' (targ (',' targ)*)? '>'
targ <- annots '?' (('extends' / 'super') jtype)? / jtype
vars <- var (',' var)*
var <- ID dims ('=' init)?
init <- arrayinit / expr
arrayinit <- '{' (init (',' init)*)? ','? '}'
block <- '{' stmt* '}'
par <- '(' expr ')'
stmt <- block / ';' / 'if' par stmt ('else' stmt)? / 'while' par stmt / 'do' stmt 'while' par ';' / 'for' '(' forctl ')' stmt / 'switch' par swbody / try / 'return' expr? ';' / 'throw' expr ';' / 'synchronized' par block / ('break' / 'continue') ID? ';' / 'assert' expr (':' expr)? ';' / 'yield' expr ';' / type / mods jtype vars ';' / ID ':' stmt / expr ';'
forctl <- mods jtype ID ':' expr / (mods jtype vars / exprs)? ';' expr? ';' exprs?
exprs <- expr (',' expr)*
try <- 'try' '(' res (';' res)* ';'? ')' block catch* finally? / 'try' block (catch+ finally? / finally)
res <- mods jtype ID '=' expr / expr
catch <- 'catch' '(' mods jtype ('|' jtype)* ID ')' block
finally <- 'finally' block
swbody <- '{' (('case' label (',' label)* (ID ternary)? / 'default') (':' stmt* / '->' (block / 'throw' expr ';' / expr ';')))* '}'
label <- 'default' / pattern / ternary
pattern <- mods jtype (ID / '(' (pattern (',' pattern)*)? ')')
expr <- lambda / ternary (assignop expr)?
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>>=' / '>>=' / '>' '>=' / '>' '>' '>='
lambda <- (ID / '(' (ID (',' ID)* &')' / params)? ')') '->' (block / expr)
ternary <- binary ('?' expr ':' (lambda / ternary))?
binary <- unary (binop unary / 'instanceof' (pattern / 'final'? jtype))*
binop <- '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '>=' / '<<' / '<' / '>' '>' '>' / '>' '>' / '>' / '+' / '-' / '*' / '/' / '%'
unary <- ('+' / '-' / '++' / '--' / '!' / '~')* ('(' jtype ('&' jtype)* ')' (lambda / !'+' !'-' !'++' !'--' unary) / postfix)
postfix <- primary suffix* ('++' / '--')*
suffix <- '.' 'new' creator / '.' targs? (ID / 'super' / 'class' / 'yield') args? / '[' expr ']' / '::' targs? ('new' / ID) / args
primary <- NUM / STR / 'new' creator / '(' expr ')' / 'switch' par swbody / 'super' / typeref / ID
typeref <- ID ('.' ID)* (targs dims / '[' ']' dims) ('::' ('new' / ID) / '.' 'class')
creator <- annots ID targs? ('.' ID targs?)* (('[' expr ']')+ dims / ('[' ']')+ arrayinit / args body?)
args <- '(' exprs? ')'
"""
C = """
file <- decl* END
decl <- ';' / ('public' / 'private' / 'protected' / ID) ':' !':' / 'extern' STR ('{' decl* '}' / decl) / 'inline'? 'namespace' attrs (ID ('::' ID)*)? '{' decl* '}' / 'namespace' ID '=' qual ';' / 'using' 'namespace' qual ';' / 'using' ID '=' type abstract ';' / 'using' 'typename'? qual ';' / 'template' ('<' tparam (',' tparam)* '>' / '<' '>')? decl / 'friend' decl / ID '(' args? ')' ';' / func / def
def <- spec* vars? ';' / 'typedef' spec+ vars ';'
spec <- attrs ('const' / 'static' / 'unsigned' / 'signed' / 'long' / 'short' / 'inline' / 'extern' / 'virtual' / 'constexpr' / 'volatile' / 'auto' / 'explicit' / 'typename' / 'typedef') / aggregate / enum / &(declword) qual
declword <- qual (ID / '*' / '&' / '&&' / 'const' / 'volatile' / 'unsigned' / 'long' / 'static' / 'operator' / '::' / '(' '*' / '~') / '::'
attrs <- ('[' '[' (!']' ANY)* ']' ']')*
aggregate <- ('class' / 'struct' / 'union') attrs qual? ('final')? (':' base (',' base)*)? '{' decl* '}' / ('class' / 'struct' / 'union') qual
base <- ('public' / 'private' / 'protected' / 'virtual')* qual
enum <- 'enum' ('class' / 'struct')? qual? (':' type)? '{' (ID ('=' ternary)? (',' ID ('=' ternary)?)* ','?)? '}' / 'enum' qual
type <- (('const' / 'volatile' / 'unsigned' / 'signed' / 'long' / 'short' / 'struct' / 'class' / 'enum' / 'union' / 'typename' / 'static' / 'constexpr' / 'auto')+ qual? / qual) ('const' / 'volatile' / 'long' / 'unsigned')* ('*' / '&' / '&&' / 'const' / 'volatile')*
qual <- '::'? part ('::' part)*
part <- '~'? ID targs? / 'operator' opname
opname <- 'new' / 'delete' / '(' ')' / '[' ']' / '->' / '<' '<' / '>' '>' / '<<' / '<=' / '>=' / '==' / '!=' / '+=' / '-=' / '*=' / '/=' / '++' / '--' / '&&' / '||' / '+' / '-' / '*' / '/' / '%' / '<' / '>' / '!' / '=' / '&' / '|' / '^' / '~' / type
targs <- '<' (targ (',' targ)*)? '>'
targ <- type abstract '...'? &(',' / '>') / add
tparam <- ('class' / 'typename') '...'? ID? ('=' type)? / 'template' '<' tparam (',' tparam)* '>' ('class' / 'typename') ID? / type '...'? ID? ('=' add)?
abstract <- ('*' / '&' / '&&' / 'const')* ('(' ('*' / '&') ')')? ('(' params? ')')? ('[' ternary? ']')*
func <- spec* ptrs fname '(' params? ')' quals (init? fbody / '=' (NUM / 'default' / 'delete') ';' / ';') / spec* ptrs '(' '*' ID '(' params? ')' ')' '(' params? ')' (block / ';')
fbody <- block / 'try' block catch+
fname <- qual
ptrs <- ('*' / '&' / '&&' / 'const' / 'volatile')*
quals <- ('const' / 'volatile' / '&&' / '&' / ID ('(' args? ')')? / 'throw' '(' (type (',' type)*)? ')' / '->' type)*
init <- ':' qual (('(' args? ')') / brace) '...'? (',' qual ('(' args? ')' / brace))*
params <- param (',' param)* (',' '...')? / '...'
param <- attrs type '...'? (declr / abstract) ('=' (brace / ternary))?
declr <- ptrs (ID / '(' ptrs ID? suffix* ')') suffix*
suffix <- '[' ternary? ']' / '(' params? ')' quals
vars <- var (',' var)*
var <- ptrs (qual / '(' ptrs qual? suffix* ')' / &':') suffix* (':' ternary)? ('=' (brace / assign) / brace / '(' args? ')')?
block <- '{' stmt* '}'
par <- '(' cond ')'
cond <- condvar / expr
condvar <- spec+ ptrs ID ('=' assign / brace)
stmt <- block / ';' / 'if' 'constexpr'? '(' (simple)? cond ')' stmt ('else' stmt)? / 'while' par stmt / 'do' stmt 'while' '(' expr ')' ';' / 'for' '(' forctl ')' stmt / 'switch' par stmt / 'case' ternary ':' / 'default' ':' / 'return' (brace / expr)? ';' / 'goto' ID ';' / ('break' / 'continue') ';' / 'throw' expr? ';' / 'try' block catch+ / 'using' (!';' unitish)+ ';' / ID ':' !':' stmt / 'template' stmt / local ';' / expr ';' / aggregate vars? ';' / enum vars? ';' / 'typedef' spec+ vars ';' / func
unitish <- !'{' !'}' ANY
simple <- local ';' / expr? ';'
local <- mod* core mod* vars / mod+ vars
core <- aggregate / enum / &(declword) qual
mod <- attrs ('const' / 'static' / 'unsigned' / 'signed' / 'long' / 'short' / 'inline' / 'extern' / 'constexpr' / 'volatile' / 'auto' / 'typename')
forctl <- spec+ ptrs (ID / '[' ID (',' ID)* ']') ':' (brace / expr) / (local / expr)? ';' (cond)? ';' expr?
catch <- 'catch' '(' ('...' / param) ')' block
expr <- assign (',' assign)*
assign <- ternary (assignop (brace / assign))? / 'throw' assign
assignop <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '>' '>='
ternary <- binary ('?' expr? ':' assign)?
binary <- unary (binop unary)*
binop <- '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '>=' / '<<' / '<' / '>' '>' / '>' / '+' / '-' / '*' / '/' / '%' / '->' '*'
add <- unary (('+' / '-' / '*' / '/' / '%' / '&&' / '||' / '==' / '!=' / '|' / '&' / '<<') unary)*
unary <- ('+' / '-' / '++' / '--' / '!' / '~' / '*' / '&' / '&&')* (sizeof / cast / 'delete' ('[' ']')? unary / new / postfix)
sizeof <- 'sizeof' '...'? ('(' type abstract ')' / unary)
cast <- '(' type abstract ')' (brace / !'+' !'-' !'&' !'*' unary / &('(') unary / ('-' / '*' / '&') NUM)
new <- '::'? 'new' ('(' args ')')? type ('[' expr ']')* ('(' args? ')' / brace)?
postfix <- primary tail* ('++' / '--')*
tail <- '(' args? ')' / '[' (brace / expr)? ']' / ('.' / '->') 'template'? qual / brace
primary <- NUM / (STR / ID STR)+ (STR / ID !tail)* / lambda / '(' expr ')' / '(' block ')' / qual / ('unsigned' / 'long' / 'short' / 'signed' / 'auto')+ ('(' args? ')' / brace)
lambda <- '[' (capture (',' capture)*)? ']' targs? ('(' params? ')')? quals block
capture <- ('&' / '=' / '*')? ID? ('=' assign)? '...'?
args <- arg (',' arg)*
arg <- brace / assign '...'? / type abstract
brace <- '{' (item (',' item)* ','?)? '}'
item <- ('.' ID / '[' ternary ('...' ternary)? ']')+ '=' (brace / assign) / brace / assign '...'?
"""
RUBY = """
file <- inner END
inner <- unit*
unit <- 'OPEN' inner 'end' / paren / bracket / brace / !('OPEN' / '(' / '[' / '{' / '}' / ')' / ']' / 'end' / END) pair
paren <- '(' inner ')'
bracket <- '[' inner ']'
brace <- '{' inner '}'
pair <- !(binop &(')' / ']' / '}' / 'end' / END)) !(ID !NLB ID !NLB ID) !('===' '===') !('<<' '<<') !('>' '>' '>' '>') ANY
binop <- '+' / '/' / '==' / '!=' / '<=' / '>=' / '&&' / '||' / '='
"""
