"""The bundled grammars, as text, and how bracketed groups may be read in each language."""

from __future__ import annotations

import re
from functools import lru_cache

from lodegraph.llm.syntax.brackets import Language, Reading
from lodegraph.llm.syntax.chart import recogniser

JAVA = r"""
topdecls : topdecl+ ;
topdecl : mods 'package' qname ';' | 'import' 'static'? qname ( '.' '*' )? ';' | typedecl | ';' ;
qname : word ( '.' word )* ;
word : ID ;
annotation : '@' qname P.annoargs? ;
annos : annotation* ;
mods : ( annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' )* ;
typedecl : mods 'class' ID tparams? ( 'extends' typ )? ( 'implements' typlist )? ( 'permits' typlist )? B.classbody
         | mods 'interface' ID tparams? ( 'extends' typlist )? ( 'permits' typlist )? B.classbody
         | mods 'enum' ID ( 'implements' typlist )? B.enumbody
         | mods '@' 'interface' ID B.classbody
         | mods 'record' ID tparams? P.params ( 'implements' typlist )? B.classbody ;
typlist : typ ( ',' typ )* ;
tparams : '<' tparam ( ',' tparam )* '>' ;
tparam : annos ID ( 'extends' typ ( '&' typ )* )? ;
prim : 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' ;
ctype : ID targs? ( '.' annos ID targs? )* ;
targs : '<' '>' | '<' targ ( ',' targ )* '>' ;
targ : annos typ | annos '?' ( ( 'extends' | 'super' ) typ )? ;
dims : K.empty+ ;
typ : annos ( prim | ctype ) dims? ;
rtype : typ | 'void' ;
members : member+ ;
member : mods typ declarators ';'
       | mods tparams? rtype ID P.params dims? throws? ( B.block | ';' | 'default' elem ';' )
       | mods tparams? ID P.params throws? B.block
       | mods ID B.block | 'static'? B.block | typedecl | ';' ;
throws : 'throws' typlist ;
declarators : declarator ( ',' declarator )* ;
declarator : ID dims? ( '=' init )? ;
init : expr | B.arrayinit ;
elem : expr | B.elems | annotation ;
param : mods typ '...'? ID dims? | mods typ ( ID '.' )? 'this' ;
params : param ( ',' param )* ;
enumbody : ( enumconst ( ',' enumconst )* )? ','? ( ';' member* )? ;
enumconst : annos ID P.args? B.classbody? ;
stmts : stmt+ ;
stmt : ';' | B.block | mods typ declarators ';' | typedecl | stmtexpr ';'
     | 'if' P.expr stmt ( 'else' stmt )? | 'while' P.expr stmt | 'do' stmt 'while' P.expr ';' | 'for' P.forhead stmt
     | 'return' expr? ';' | 'throw' expr ';' | 'break' ID? ';' | 'continue' ID? ';' | 'yield' expr ';'
     | 'try' P.resources B.block handler* | 'try' B.block handler+
     | 'switch' P.expr B.block | 'synchronized' P.expr B.block | 'assert' expr ( ':' expr )? ';' | ID ':' stmt
     | 'case' caselabel ( ',' caselabel )* ( ':' | '->' arrowbody ) | 'default' ( ':' | '->' arrowbody )
     | ( 'this' | 'super' ) P.args ';' | primary '.' 'super' P.args ';' ;
caselabel : binary | binary '?' expr ':' expr | typ ID | 'default' ;
arrowbody : expr ';' | B.block | 'throw' expr ';' ;
handler : 'catch' P.catchparam B.block | 'finally' B.block ;
stmtexpr : lhs assignop expr | incdec unary | primary incdec | call | newexpr | switchexpr ;
call : ( primary '.' )? targs? ID P.args | 'super' '.' targs? ID P.args ;
incdec : '++' | '--' ;
assignop : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<' '<=' | '>' '>=' | '>' '>' '>=' ;
lhs : primary ;
expr : binary | binary '?' expr ':' expr | lhs assignop expr | lambda ;
lambda : ( ID | P.lambda ) '->' ( expr | B.block ) ;
binary : unary ( binop unary | 'instanceof' 'final'? typ ID? )* ;
binop : '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<' '<' | '>' '>' | '>' '>' '>' ;
unary : ( '+' | '-' | '!' | '~' | '++' | '--' ) unary | P.cast ( unary | lambda ) | primary incdec* ;
primary : LIT | 'this' | ID | P.expr | newexpr | switchexpr | call
        | primary '.' ID | primary '.' ( 'this' | 'class' | 'super' ) | primary '.' newexpr | 'super' '.' ID
        | primary K.index | ( primary | typ | 'super' ) '::' targs? ( ID | 'new' ) | ( typ | 'void' ) '.' 'class' ;
switchexpr : 'switch' P.expr B.block ;
newexpr : 'new' annos targs? ctype P.args B.classbody? | 'new' annos ( prim | ctype ) K.index+ dims? | 'new' annos ( prim | ctype ) dims B.arrayinit ;
forhead : forinit? ';' expr? ';' forupdate? | mods typ ID ':' expr ;
forinit : mods typ declarators | forupdate ;
forupdate : stmtexpr ( ',' stmtexpr )* ;
resources : resource ( ';' resource )* ';'? ;
resource : mods typ ID '=' expr | primary ;
catchparam : mods typ ( '|' typ )* ID ;
casttype : typ ( '&' typ )* ;
args : expr ( ',' expr )* ;
annoarg : ID '=' elem | elem ;
lambdaparam : ID | param ;
lambdaparams : lambdaparam ( ',' lambdaparam )* ;
"""

_JAVA_CONT = frozenset("else catch finally while ; ) , . [ ( -> :: ? : = + - * / % < > <= >= == != && || & | ^ instanceof ++ --".split())


def _java(top: Reading) -> Language:
    return Language(
        recogniser(JAVA),
        {
            "(": [
                Reading("args", "expr", ",", whole="args"), Reading("params", "param", ",", whole="params"), Reading("expr", "expr", empty=False), Reading("cast", "casttype", empty=False),
                Reading("forhead", "forhead", empty=False), Reading("resources", "resources", empty=False), Reading("catchparam", "catchparam", empty=False),
                Reading("lambda", "lambdaparam", ",", whole="lambdaparams"), Reading("annoargs", "annoarg", ","),
            ],
            "[": [Reading("empty", "expr", empty=True, separator="\0"), Reading("index", "expr", empty=False)],
            "{": [
                Reading("block", "stmts", statements=True), Reading("classbody", "members", statements=True),
                Reading("arrayinit", "init", ",", trailing=True), Reading("elems", "elem", ",", trailing=True), Reading("enumbody", "enumbody"),
            ],
        },
        top,
        continues=_JAVA_CONT,
    )


JAVASCRIPT = r"""
stmts : stmt+ EOS? ;
semi : ';' | NL | EOS ;
name : ID | KW ;
stmt : ';' | B.block | ( 'var' | 'let' | 'const' ) bind ( ',' bind )* semi | funcdecl | classdecl | expr semi
     | 'if' P.expr NL? stmt ( NL? 'else' stmt )? | 'for' 'await'? P.forhead NL? stmt | 'while' P.expr NL? stmt | 'do' stmt 'while' P.expr semi? | 'with' P.expr stmt
     | 'return' expr? semi | 'throw' expr semi | 'break' ID? semi | 'continue' ID? semi | 'debugger' semi
     | 'try' B.block ( 'catch' P.target? B.block )? ( 'finally' B.block )? | 'switch' P.expr B.block | ID ':' stmt | 'case' expr ':' | 'default' ':'
     | 'import' ( importclause 'from' )? STR semi | 'export' ( 'var' | 'let' | 'const' ) bind ( ',' bind )* semi | 'export' ( funcdecl | classdecl )
     | 'export' 'default' ( assign semi | funcdecl | classdecl ) | 'export' B.names ( 'from' STR )? semi | 'export' '*' ( 'as' name )? 'from' STR semi ;
importclause : ID | B.names | '*' 'as' ID | ID ',' ( B.names | '*' 'as' ID ) ;
importname : ( name | STR ) ( 'as' name )? ;
bind : target ( '=' assign )? ;
target : ID | K.array | B.object ;
funcdecl : 'async'? 'function' '*'? ID? P.params B.block ;
classdecl : 'class' ID? ( 'extends' lhs )? B.classbody ;
expr : assign ( ',' assign )* ;
assign : cond | lhs assignop assign | arrow | 'yield' '*'? assign? ;
assignop : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
arrow : 'async'? ( ID | P.params ) '=>' ( assign | B.block ) ;
cond : binary ( '?' assign ':' assign )? ;
binary : unary ( binop unary )* ;
binop : '+' | '-' | '*' | '/' | '%' | '**' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '>>' | '>>>' | 'in' | 'instanceof' ;
unary : ( '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' ) unary | lhs ( '++' | '--' )? ;
lhs : primary suffix* ;
suffix : '.' name | '?.' ( name | P.args | K.index ) | K.index | P.args | TPL ;
primary : ID | NUM | STR | TPL | REGEX | 'this' | 'null' | 'true' | 'false' | 'super' | 'import' | P.expr | K.array | B.object | funcdecl | classdecl | 'new' lhs | 'new' '.' ID ;
param : bind | '...' target ;
element : assign | '...' assign ;
pname : name | STR | NUM | K.index ;
method : ( 'get' | 'set' | 'async' | '*' | 'static' )* pname P.params B.block ;
prop : pname ':' assign | ID ( '=' assign )? | '...' assign | method ;
cmembers : cmember+ EOS? ;
cmember : ';' | method | 'static'? pname ( '=' assign )? semi | 'static' B.block ;
forhead : ( ( 'var' | 'let' | 'const' ) bind ( ',' bind )* | expr )? ';' expr? ';' expr? | ( 'var' | 'let' | 'const' )? ( target | lhs ) ( 'of' | 'in' ) expr ;
"""

_JS_CONT = frozenset(["KW else", "KW catch", "KW finally", "KW while", "KW in", "KW instanceof", "ID of", "ID from", "TPL", "NL"] + "; ) , . ?. ( [ => = ? : + - * / % ** < > <= >= == != === !== && || ?? & | ^ << >> >>> ++ -- += -=".split())


def _javascript() -> Language:
    return Language(
        recogniser(JAVASCRIPT),
        {
            "(": [Reading("args", "element", ",", trailing=True), Reading("params", "param", ",", trailing=True), Reading("expr", "assign", ",", empty=False), Reading("forhead", "forhead", empty=False), Reading("target", "target", empty=False)],
            "[": [Reading("array", "element", ",", trailing=True, holes=True), Reading("index", "assign", ",", empty=False)],
            "{": [Reading("block", "stmts", statements=True), Reading("object", "prop", ",", trailing=True), Reading("classbody", "cmembers", statements=True), Reading("names", "importname", ",", trailing=True)],
        },
        Reading("program", "stmts", statements=True),
        continues=_JS_CONT,
        end="EOS",
        block_first=True,
    )


CSS = r"""
items : item+ ;
item : selector B.body | AT any* ( ';' | B.body ) | declaration ';' | ';' ;
selector : simple+ ( ',' simple+ )* ;
simple : ID | HASH | '.' ID | '*' | '&' | NUM | K.any | ':' ID P.any? | ':' ':' ID P.any? | '>' | '+' | '~' ;
any : ID | HASH | NUM | STR | P.any | K.any | ',' | ':' | '.' | '*' | '+' | '-' | '/' | '>' | '<' | '=' | '~' ;
declaration : ( ID | '*' ID ) ':' any+ ( '!' ID )? ;
anys : ( any | '|' | '^' | '$' | '!' | ';' | '&' )+ ;
"""


def _css() -> Language:
    return Language(
        recogniser(CSS),
        {"(": [Reading("any", "anys")], "[": [Reading("any", "anys")], "{": [Reading("body", "declaration", ";", trailing=True, holes=True, whole="items")]},
        Reading("sheet", "items", statements=True),
        continues=frozenset(),
    )


JSON = r"""
value : STR | LIT | B.object | K.array ;
pair : STR ':' value ;
"""


def _json() -> Language:
    return Language(recogniser(JSON), {"(": [], "[": [Reading("array", "value", ",")], "{": [Reading("object", "pair", ",")]}, Reading("document", "value", empty=False))


SQL = r"""
script : stmt+ EOS? ;
stmt : command ';' | ';' | '/' | label* block ';' | unit ';' | command EOS ;
command : query | insert | update | delete | merge | create | alter | comment | other ;
query : withclause? select ( setop select )* orderby? forupdate? ;
withclause : 'with' ID P.names? 'as' P.query ( ',' ID P.names? 'as' P.query )* ;
setop : ( 'union' 'all'? ) | 'minus' | 'intersect' | 'except' ;
select : P.query | 'select' ( 'distinct' | 'all' | 'unique' )? selitem ( ',' selitem )* into? ( 'from' fromitem ( ',' fromitem )* )? where? hierarchy* groupby? ;
into : ( 'bulk' 'collect' )? 'into' e ( ',' e )* ;
selitem : e ( 'as'? ID )? | '*' | qname '.' '*' ;
fromitem : source join* ;
source : ( qname ( '@' ID )? | P.query | P.source | ID P.args ) ( 'as'? ID )? ;
join : ( 'inner' | ( 'left' | 'right' | 'full' ) 'outer'? | 'natural' )? 'join' source ( 'on' e | 'using' P.names ) | ( 'cross' | 'natural' ) 'join' source ;
where : 'where' e ;
hierarchy : 'connect' 'by' 'nocycle'? e | 'start' 'with' e ;
groupby : 'group' 'by' e ( ',' e )* ( 'having' e )? | 'having' e ;
orderby : 'order' 'siblings'? 'by' ord ( ',' ord )* ;
ord : e ( 'asc' | 'desc' )? ( 'nulls' ( 'first' | 'last' ) )? ;
forupdate : 'for' 'update' ( 'of' e )? ( 'nowait' | 'wait' NUM )? ;
qname : ID ( '.' ID )* ;
insert : 'insert' 'into' qname ID? P.names? ( 'values' P.args | query ) returning? ;
update : 'update' qname ID? 'set' setitem ( ',' setitem )* where? returning? ;
setitem : ( qname | P.names ) '=' e ;
delete : 'delete' 'from'? qname ID? where? returning? ;
returning : 'returning' e ( ',' e )* 'into' e ( ',' e )* ;
merge : 'merge' 'into' qname ID? 'using' ( qname | P.query ) ID? 'on' P.args mergepart+ ;
mergepart : 'when' 'not'? 'matched' 'then' ( 'update' 'set' setitem ( ',' setitem )* where? ( 'delete' where )? | 'insert' P.names? 'values' P.args where? ) ;
e : unary ( binop unary )* ;
binop : '+' | '-' | '*' | '/' | '||' | '=' | '<>' | '!=' | '^=' | '<' | '>' | '<=' | '>=' | 'and' | 'or' | '=>' | '%' | '**' | 'mod' ;
unary : ( '-' | '+' | 'not' | 'prior' | 'all' | 'any' | 'some' | 'distinct' ) unary | prim post* ;
post : 'is' 'not'? ( 'null' | ID ) | 'not'? 'in' ( P.args | P.query | prim ) | 'not'? 'between' sum 'and' sum | 'not'? 'like' sum ( 'escape' prim )? | P.outer | 'over' P.any | 'within' 'group' P.any | 'keep' P.any | 'at' 'time' 'zone' prim ;
sum : ( '-' | '+' )? prim ( ( '+' | '-' | '*' | '/' | '||' ) ( '-' | '+' )? prim )* ;
prim : qname | qname ( P.args | P.any ) ( '.' ID P.args? )* | NUM | STR | BIND | 'null' | '*' | P.args | P.query | 'case' e? when+ ( 'else' e )? 'end' | 'exists' P.query | 'date' STR | 'timestamp' STR | 'interval' STR ID ( 'to' ID )? | ( 'left' | 'right' | 'set' | 'if' ) P.args ;
when : 'when' e 'then' e ;
create : 'create' ( 'or' 'replace' )? ( 'global' 'temporary' )? 'table' qname P.columns tails? | 'create' ( 'or' 'replace' )? ( 'global' 'temporary' )? 'table' qname tails? 'as' query
       | 'create' ( 'or' 'replace' )? ( 'force' | 'no' 'force' )? 'materialized'? 'view' qname P.names? 'as' query tails?
       | 'create' ( 'unique' | 'bitmap' )? 'index' qname 'on' qname P.args tails? | 'create' ( 'or' 'replace' )? 'public'? 'synonym' qname 'for' qname ( '@' ID )?
       | 'create' 'sequence' qname tails? | 'create' 'user' qname 'identified' 'by' ( ID | STR ) tails? | 'create' 'public'? 'database' 'link' qname 'connect' 'to' qname 'identified' 'by' ( ID | STR ) ( 'using' STR )?
       | 'create' ( 'role' | 'tablespace' | 'directory' | 'profile' ) tails ;
tails : setting ( ','? setting )* ;
setting : word ( '=' word )? | P.any ;
word : ID ( '.' ID )* | NUM | STR | 'on' | 'as' | 'with' | 'null' | 'not' | 'by' | 'set' | 'for' | 'in' | 'start' ;
column : ID dtype copt* | ( 'constraint' ID )? tcons copt* ;
columns : column ( ',' column )* ;
dtype : ID P.args? ( '%' ID )? | ID ID P.args? ID? | ID P.args 'with' ID? ID ID | ID 'with' ID ID | qname '%' ID ;
copt : 'default' e | 'not' 'null' | 'null' | 'primary' 'key' | 'unique' | 'references' qname P.names? ( 'on' 'delete' ( 'cascade' | 'set' 'null' ) )? | 'check' P.args | 'constraint' ID | 'enable' | 'disable' | 'using' 'index' | 'generated' tails ;
tcons : 'primary' 'key' P.names | 'unique' P.names | 'foreign' 'key' P.names 'references' qname P.names? ( 'on' 'delete' ( 'cascade' | 'set' 'null' ) )? | 'check' P.args ;
alter : 'alter' 'table' qname altop+ | 'alter' 'session' 'set' ID '=' ( STR | ID | NUM ) | 'alter' 'system' tails | 'alter' 'user' qname ( 'identified' 'by' ( ID | STR ) | ID )+ | 'alter' ( 'index' | 'sequence' | 'trigger' | 'view' | 'procedure' | 'package' | 'function' | 'database' ) qname tails ;
altop : 'add' ( P.columns | column ) | 'modify' ( P.columns | column ) | 'drop' ( setting | P.names )+ | 'rename' tails | 'enable' tails | 'disable' tails ;
comment : 'comment' 'on' ( 'table' | 'column' ) qname 'is' STR ;
other : 'commit' ID? | 'rollback' tails? | 'savepoint' ID | ( 'grant' | 'revoke' ) granted+ | 'drop' ( 'table' | ID ) tails | 'truncate' 'table' qname tails? | 'set' tails? | 'prompt' tails? | 'exec' e | 'lock' 'table' tails | 'call' e | 'explain' tails? | 'spool' tails? | 'whenever' tails? | 'exit' | 'purge' tails? | 'rename' tails | 'analyze' 'table' tails ;
granted : privilege ( ','? privilege )* ;
privilege : setting | 'select' | 'insert' | 'update' | 'delete' | 'create' | 'alter' | 'drop' | 'table' | '/' ;
label : '<' '<' named '>' '>' ;
named : ID | 'outer' | 'inner' ;
block : ( 'declare' decl* )? 'begin' pstmts handlers? 'end' ID? ;
pstmts : pstmt+ ;
pstmt : label* ( simple ';' | block ';' | 'if' e 'then' pstmts ( 'elsif' e 'then' pstmts )* ( 'else' pstmts )? 'end' 'if' ';'
      | loophead? 'loop' pstmts 'end' 'loop' named? ';' | 'case' e? ( 'when' e 'then' pstmts )+ ( 'else' pstmts )? 'end' 'case' ID? ';' ) ;
loophead : 'while' e | 'for' ID 'in' 'reverse'? ( e '..' e | P.query | qname P.args? ) ;
handlers : 'exception' ( 'when' e 'then' pstmts )+ ;
place : ( qname | BIND ) P.args? ( '.' ID P.args? )* ;
simple : place ':=' e | place | 'null' | 'return' e? | 'raise' qname? | ( 'exit' | 'continue' ) named? ( 'when' e )? | 'goto' ID | 'open' place ( 'for' ( query | e ) using? )? | 'close' place
       | 'fetch' place into ( 'limit' e )? | 'execute' 'immediate' e into? using? returning? | 'pipe' 'row' P.args | 'forall' ID 'in' ( e '..' e | ( 'indices' | 'values' ) 'of' qname ) ( 'save' ID )? ( insert | update | delete | merge | 'execute' 'immediate' e using? ) | command ;
using : 'using' ( 'in' | 'out' )* e ( ',' ( 'in' | 'out' )* e )* ;
decl : ID 'constant'? dtype ( 'not' 'null' )? ( ( ':=' | 'default' ) e )? ';' | ID 'exception' ';' | 'cursor' ID P.params? ( 'return' dtype )? ( 'is' query )? ';' | 'type' ID 'is' typedef ';'
     | 'subtype' ID 'is' dtype ( 'not' 'null' )? ';' | 'pragma' ID P.any? ';' | subprogram ';' ;
typedef : 'record' P.columns | 'table' 'of' dtype ( 'not' 'null' )? ( 'index' 'by' dtype )? | 'varray' P.args 'of' dtype | 'ref' 'cursor' ( 'return' dtype )? | 'object' P.columns ;
subprogram : ( 'procedure' qname P.params? | 'function' qname P.params? 'return' dtype ID* ) ( 'authid' ID )? ( ( 'is' | 'as' ) body )? ;
body : decl* 'begin' pstmts handlers? 'end' ID? | 'language' tails ;
unit : 'create' ( 'or' 'replace' )? ( 'editionable' | 'noneditionable' )? ( subprogram | 'package' qname ( 'authid' ID )? ( 'is' | 'as' ) decl* 'end' ID?
     | 'package' 'body' qname ( 'is' | 'as' ) decl* ( 'begin' pstmts handlers? )? 'end' ID? | trigger | 'type' qname ( 'is' | 'as' ) typedef ) ;
trigger : 'trigger' qname ( 'before' | 'after' | 'instead' 'of' ) event ( 'or' event )* 'on' qname ( 'referencing' tails )? ( 'for' 'each' ID )? ( 'when' P.args )? block ;
event : 'insert' | 'update' ( 'of' ID ( ',' ID )* )? | 'delete' ;
parameter : ID 'in'? 'out'? 'nocopy'? dtype ( ( ':=' | 'default' ) e )? ;
args : argument ( ',' argument )* ;
argument : e ( 'as' ID P.args? )? | e ID | e 'from' e ;
anys : anyt+ ;
anyt : ID | KW | NUM | STR | BIND | P.any | P.args | P.query | ',' | '.' | '=' | '+' | '-' | '*' | '/' | '||' | '<' | '>' | '<=' | '>=' | '<>' | '!=' | ':=' | '%' ;
names : ID ( '.' ID )* ( 'asc' | 'desc' )? ;
nothing : '+' ;
sourcein : fromitem ;
"""


def _sql() -> Language:
    return Language(
        recogniser(SQL),
        {
            "(": [
                Reading("args", "argument", ",", whole="args"), Reading("query", "query", empty=False), Reading("names", "names", ",", empty=False), Reading("columns", "column", ",", empty=False, whole="columns"),
                Reading("outer", "nothing", empty=False), Reading("source", "sourcein", empty=False), Reading("params", "parameter", ",", empty=False), Reading("any", "anys"),
            ],
            "[": [],
            "{": [],
        },
        Reading("script", "script", statements=True),
        end="EOS",
    )


PYTHON = r"""
stmts : stmt+ ;
suite : ':' ( I.block | simples NEWLINE ) ;
stmt : simples NEWLINE | NEWLINE | 'if' named suite | 'elif' named suite | 'else' suite | 'while' named suite | 'async'? 'for' targets 'in' exprs suite | 'try' suite | 'except' '*'? ( e ( 'as' ID )? | e ( ',' e )+ )? suite | 'finally' suite
     | 'async'? 'with' ( withitem ( ',' withitem )* | P.withitems ) suite | 'async'? 'def' ID P.params ( '->' e )? suite | 'class' ID P.args? suite | '@' named NEWLINE | ID e suite | ID exprs suite ;
chain : ifchain | trychain | stmt ;
ifchain : 'if' named suite ( 'elif' named suite )* ( 'else' suite )? ;
trychain : 'try' suite ( 'except' '*'? ( e ( 'as' ID )? | e ( ',' e )+ )? suite )* ( 'else' suite )? ( 'finally' suite )? ;
withitem : e ( 'as' target )? ;
withitems : withitem ( ',' withitem )* ','? ;
simples : simple ( ';' simple )* ';'? ;
simple : exprs ( '=' ( exprs | yields ) )* | target ':' e ( '=' exprs )? | target augop ( exprs | yields ) | yields | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' ( e ( 'from' e )? )? | 'del' exprs | 'assert' e ( ',' e )? | ( 'global' | 'nonlocal' ) ID ( ',' ID )*
       | 'import' dotted ( 'as' ID )? ( ',' dotted ( 'as' ID )? )* | 'from' ( '.' | '...' )* dotted? 'import' ( '*' | imports | P.imports ) ;
imports : importas ( ',' importas )* ','? ;
importas : ID ( 'as' ID )? ;
dotted : ID ( '.' ID )* ;
augop : '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '**=' | '>>=' | '<<=' | '&=' | '|=' | '^=' | '@=' ;
yields : 'yield' ( 'from' e | exprs )? ;
targets : starred ( ',' starred )* ','? ;
target : post ;
starred : '*'? post ;
exprs : star ( ',' star )* ','? ;
star : '*'? e | ID ':=' e ;
named : ID ':=' e | e ;
e : or ( 'if' or 'else' e )? | 'lambda' lparams? ':' e ;
lparams : lparam ( ',' lparam )* ','? ;
lparam : ( '*' | '**' )? ID ( '=' e )? | '*' | '/' ;
or : unary ( binop unary )* ;
binop : '+' | '-' | '*' | '/' | '//' | '%' | '**' | '<<' | '>>' | '&' | '|' | '^' | '@' | '<' | '>' | '<=' | '>=' | '==' | '!=' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'? ;
unary : ( '-' | '+' | '~' | 'not' | 'await' ) unary | post ;
post : atom | post '.' ID | post P.args | post K.index ;
atom : ID | LIT | STR+ | 'None' | 'True' | 'False' | '...' | P.tuple | P.gen | K.list | B.dict | B.set ;
arg : named | ID '=' e | '*' e | '**' e | gen ;
gen : star compfor+ ;
compfor : 'async'? 'for' targets 'in' or ( 'if' cond )* ;
cond : or | 'lambda' lparams? ':' e ;
argsall : arg ( ',' arg )* ','? ;
param : ( '*' | '**' )? ID ( ':' e )? ( '=' e )? | '*' | '/' ;
index : sub ( ',' sub )* ','? ;
sub : star | e? ':' e? ( ':' e? )? ;
pair : e ':' e | '**' e | e ':' e compfor+ ;
tuplegen : star compfor+ | yields ;
"""


def _python() -> Language:
    return Language(
        recogniser(PYTHON),
        {
            "(": [Reading("args", "arg", ",", trailing=True, whole="argsall"), Reading("params", "param", ",", trailing=True), Reading("tuple", "star", ",", trailing=True, whole="exprs"), Reading("gen", "tuplegen", empty=False), Reading("withitems", "withitems", empty=False), Reading("imports", "importas", ",", empty=False, trailing=True)],
            "[": [Reading("list", "star", ",", trailing=True, whole="gen"), Reading("index", "sub", ",", empty=False, trailing=True)],
            "{": [Reading("dict", "pair", ",", trailing=True, whole="pair"), Reading("set", "star", ",", empty=False, trailing=True, whole="gen")],
            "INDENT": [Reading("block", "stmts", empty=False, statements=True)],
        },
        Reading("module", "stmts", statements=True),
        continues=frozenset(["KW else", "KW elif", "KW except", "KW finally"]),
        semicolon="NEWLINE",
        block="I",
    )


EL = r"""
el : or ( '?' el ':' el )? ;
or : unary ( binop unary )* ;
binop : '+' | '-' | '*' | '/' | '%' | 'div' | 'mod' | '==' | '!=' | '<' | '>' | '<=' | '>=' | 'eq' | 'ne' | 'lt' | 'gt' | 'le' | 'ge' | '&&' | '||' | 'and' | 'or' | '+=' ;
unary : ( '-' | '!' | 'not' | 'empty' ) unary | prim post* ;
post : '.' ID | K.el | P.args ;
prim : ID ( ':' ID )? | LIT | P.el ;
"""


def _el() -> Language:
    return Language(recogniser(EL), {"(": [Reading("el", "el", empty=False), Reading("args", "el", ",")], "[": [Reading("el", "el", empty=False)], "{": []}, Reading("expression", "el", empty=False))


FLOW = r"""
value : SCALAR | B.map | K.list ;
entry : value | value? ':' value? | '?' value ( ':' value? )? ;
"""


def _flow() -> Language:
    return Language(recogniser(FLOW), {"(": [], "[": [Reading("list", "entry", ",", trailing=True)], "{": [Reading("map", "entry", ",", trailing=True)]}, Reading("flow", "value", empty=False))


#: Words that the SQL grammar names; all others are plain identifiers.
SQL_WORDS = frozenset(re.findall(r"'([a-z]\w*)'", SQL))


@lru_cache(maxsize=32)
def language(name: str) -> Language:
    make = {
        "java": lambda: _java(Reading("unit", "topdecls", statements=True)),
        "java block": lambda: _java(Reading("block", "stmts", statements=True)),
        "java members": lambda: _java(Reading("members", "members", statements=True)),
        "java expression": lambda: _java(Reading("expression", "expr", empty=False)),
        "el": _el, "flow": _flow, "javascript": _javascript, "css": _css, "json": _json, "sql": _sql, "python": _python,
    }
    return make[name]()
