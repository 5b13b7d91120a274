"""Grammars of the languages whose files are checked.

Token kinds: n name, M name that may be a macro (all capitals, two underscores; also a name), 0 number, s text, o any other binary or assignment sign; keywords and signs stand for themselves.
Groups in brackets are parsed first and stand as one token, see ``chart.Grammar``.
"""

PYTHON = """
line: simple | compound
simple: small (';' small)* ';'?
small: exprs assign? | yieldx | 'return' exprs? | 'pass' | 'break' | 'continue' | 'del' exprs | 'raise' (expr ('from' expr)?)?
  | 'global' nm (',' nm)* | 'nonlocal' nm (',' nm)* | 'assert' expr (',' expr)? | 'import' dotted ('as' nm)? (',' dotted ('as' nm)?)*
  | 'from' ('.' | '...')* dotted 'import' what | 'from' ('.' | '...')+ 'import' what | 'type' nm tparams? '=' expr
what: '*' | imps | '(I'
imps: nm ('as' nm)? (',' nm ('as' nm)?)*
dotted: nm ('.' nm)*
assign: ':' expr ('=' rhs)? | ('=' rhs)+ | 'aug' rhs
rhs: exprs | yieldx
yieldx: 'yield' | 'yield' 'from' expr | 'yield' exprs
exprs: item (',' item)* ','?
item: '*' bin | named
named: expr (':=' expr)?
expr: bin ('if' bin 'else' expr)? | 'lambda' lparams? ':' expr
bin: un (bop un)*
bop: 'o' | '*' | '**' | '-' | '+' | '@' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | 'and' | 'or'
un: ('-' | '+' | '~' | 'not' | 'await')* prim
prim: atom trailer*
atom: nm | '0' | 's'+ | '...' | '(E' | '[E' | '{E'
trailer: '.' nm | '(E' | '[S'
nm: 'n' | 'match' | 'case' | 'type'
lparams: lparam (',' lparam)* ','?
lparam: nm ('=' expr)? | '*' nm? | '**' nm | 'o'
compound: 'if' named ':' tail | 'elif' named ':' tail | 'else' ':' tail | 'while' named ':' tail | forx | withx | defx
  | 'async' forx | 'async' withx | 'async' defx | 'class' nm tparams? '(E'? ':' tail | '@' named | 'try' ':' tail | 'finally' ':' tail
  | 'except' '*'? (exprs ('as' nm)?)? ':' tail | 'match' exprs ':' | 'case' pats ('if' named)? ':' tail
tail: simple?
forx: 'for' targets 'in' exprs ':' tail
withx: 'with' wi (',' wi)* ':' tail | 'with' '(W' ':' tail
wi: expr ('as' prim)?
tparams: '[E' | '[S'
defx: 'def' nm tparams? '(P' ('->' expr)? ':' tail
targets: target (',' target)* ','?
target: '*'? prim
pats: pat (',' pat)* ','?
pat: '*'? bin ('as' nm)?
round_e: (arg (',' arg)* ','?)?
arg: named gen? | nm '=' expr | '*' expr | '**' expr | yieldx
gen: ('async'? 'for' targets 'in' bin ('if' named_bin)*)+
named_bin: bin (':=' bin)? | 'lambda' lparams? ':' expr
round_p: (par (',' par)* ','?)?
par: nm (':' expr)? ('=' expr)? | '*' (nm (':' item)?)? | '**' nm (':' expr)? | 'o'
round_i: imps ','?
round_w: wi (',' wi)* ','?
square_e: (arg (',' arg)* ','?)?
square_s: sl (',' sl)* ','?
sl: named | ('*' | '**') expr | expr? ':' expr? (':' expr?)? | nm ':' expr '=' expr | nm '=' expr
curly_e: (de (',' de)* ','?)?
de: expr ':' expr gen? | item gen? | '**' bin
"""

C = """
seg: pre_seg* core
pre_seg: 'case' tern ':' | 'default' ':' | 'n' ':' | 'a' ':' | 'a' 'n' ':' | 'if' ('t' | '!')* '(E' | 'else' | 'for' '(E' | 'while' '(E' | 'switch' '(E' | 'do'
  | 'template' '<' items? | 'template' '<' '>' | 'template' | '[E' | 't' 's' | 'M' | 'M' '(E'
core: ';' | items ';' | item ':' tern ';' | 'return' items? ';' | 'break' ';' | 'continue' ';' | 'goto' 'n' ';' | 'u' ';' | '{B' | 'try' '{B' | 'catch' '(E' '{B'
  | 'typedef' items ';' | 'typedef' cls items? ';' | 'using' 'namespace'? items ';' | sig quals? ('->' item)? (':' items)? 'try'? '{B'
  | 't'? 'namespace' space? '{B' | 'namespace' 'n' 'o' items ';' | cls ';' | cls items ';' | 'n' '(E' quals? ';' | cls_head ';'
sig: ('n' | 't' | 'c' | '*' | '&' | '&&' | '::' | '<' | '>' | '~' | ',' | '[E' | '(E' | '0' | 'o' | 'rr' | '...' | 'M')* '(E'
space: '[E'? 't'? 'n' ('::' 't'? 'n')*
quals: ('q' | 't' | 'u' '(E' | '(E' | '&' | '&&' | 'M')+
cls: cls_head (':' bases)? ('{B' | '{I') 't'*
cls_head: 't'* 'c' 'c'? ('n' | '[E' | '(E' | '::' | '<' items | '<' '>')* 'q'?
bases: base (',' base)*
base: ('a' | 't')* item
items: item (',' item)*
item: tern ptrs?
ptrs: ('*' | '&' | '&&' | '...' | 't' | 'q' | '>' | 'rr')+
tern: chain ('?' items? ':' tern)?
chain: unit (bop unit)*
bop: 'o' | '*' | '&' | '&&' | '-' | '+' | '<' | '>' | 'rr' | ptrs '>' | ptrs 'rr' | ptrs 'o'
unit: decl? pre* atom post* | decl
decl: ('t' | 'c' | 'a' 't' | 'M' | 'M' '(E')* qual 't'* 'n'? | ('t' | 'c' | 'M')+
qual: '::'? 'n' ('::' 'n')*
pre: '*' | '&' | '&&' | '-' | '+' | '!' | '~' | 'u' | 'u' '[E' | '++' | '--' | '::' | 't' | '(E' | '...'
atom: 'n' | '0' | 's' ('s' | 'n')* | 'v' | 'u' | 'default' | '(E' | '{I' | '[E' '(E'? ('t' | 'q' | '->' unit)* '{B' | '[E' | 'c' 'n'? '{I'
post: '.' '~'? 'n' | '->' '~'? 'n' | '::' '~'? 'n' | '::' '*' | '::' 'template' 'n' | '[E' | '(E' | '{I' | '++' | '--' | '...' | 'q' | '<' '>' | 's' | 'M' | 'M' '(E' | 't' '(E'
round_e: parg_list? | parg_list? ';' parg_list? | parg_list? ';' parg_list? ';' parg_list? | '{B'
parg_list: parg (',' parg)* ','?
parg: item | item ':' item | '...' | 'o' | '*' | '&' | '<' | '>' | '...' 'n'
square_e: (cap (',' cap)* ','?)?
cap: 'o' | '&' | '*' 'v' | item
curly_i: (iit (',' iit)* ','?)?
iit: item | ('.' 'n')+ ('o' item | '{I') | '[E' 'o'? item
eof: 'n' '(E' | ('M' '(E'?)+
"""

JS = """
seg: pre_seg* core
pre_seg: 'case' item ':' | 'default' ':' | nm ':' | 'if' '(E' | 'else' | 'for' 'await'? '(E' | 'while' '(E' | 'with' '(E' | 'switch' '(E' | 'do'
core: ';' | items ';' | 'V' items ';' | 'return' items? ';' | 'break' nm? ';' | 'continue' nm? ';' | 'throw' items ';' | 'debugger' ';' | '{B' | func | classx
  | 'try' '{B' | 'catch' '(E'? '{B' | 'finally' '{B' | 'import' 's' attrs? ';' | 'import' impc (',' impc)? 'from' 's' attrs? ';' | 'export' exported
attrs: 'with' '{O'
impc: nm | '*' 'as' nm | '{M'
exported: 'default' func | 'default' classx | 'default' items ';' | 'V' items ';' | func | classx | '{M' ('from' 's')? ';' | '*' ('as' key)? 'from' 's' ';'
func: 'async'? 'function' '*'? nm? '(E' '{B'
classx: 'class' nm? ('extends' unit)? '{C'
items: item (',' item)*
item: chain ('?' item ':' item)? | arrow | 'yield' '*'? item?
arrow: 'async'? (nm | '(E') '=>' ('{B' | item)
chain: unit (bop unit)* (bop arrow)? (bop 'yield' '*'? item)?
bop: 'o' | '*' | '-' | '+' | 'in' | 'instanceof' | 'of'
unit: pre* atom post*
pre: '!' | '~' | '-' | '+' | '++' | '--' | 'u' | 'await'
atom: nm | '0' | 's' | 'r' | 'v' | '(E' | '[E' | '{O' | func | classx | 'import' | 'super'
post: 'm' | '(E' | '[E' | '?.' '(E' | '?.' '[E' | 's' | '++' | '--' | '!'
nm: 'n' | 'from' | 'as' | 'of' | 'async' | 'get' | 'set' | 'static'
key: nm | 's' | '0' | '[E' | 'V' | 'if' | 'else' | 'for' | 'while' | 'do' | 'switch' | 'case' | 'default' | 'return' | 'break' | 'continue' | 'throw' | 'try' | 'catch' | 'finally'
  | 'import' | 'export' | 'function' | 'class' | 'extends' | 'u' | 'v' | 'in' | 'instanceof' | 'super' | 'with' | 'await' | 'yield' | 'debugger'
round_e: arg_list? | head? ';' items? ';' items? | 'V' item
arg_list: arg (',' arg)* ','?
arg: '...'? item
head: 'V'? items
square_e: ','* (arg ','* | arg ','+ )* 
curly_o: (prop (',' prop)* ','?)?
prop: key ':' item | nm ('o' item)? | '...' item | ('async' | 'get' | 'set' | '*')* key '(E' '{B' | 'h'
curly_m: (spec (',' spec)* ','?)?
spec: key ('as' key)?
curly_c: member*
member: ';' | mods key '(E' '{B' | mods key ('o' item)? ';' | mods 'h' ('o' item)? ';' | mods 'h' '(E' '{B' | 'static' '{B'
mods: ('static' | 'async' | 'get' | 'set' | '*')*
"""

JSON = """
document: value
value: 's' | '0' | 'v' | '{E' | '[E'
curly_e: ('s' ':' value (',' 's' ':' value)*)?
square_e: (value (',' value)*)?
"""

TOML = """
line: '[T' | key '=' value
key: part ('.' part)*
part: 'n' | 's' | '0'
value: 's' | '0' | 'v' | '[E' | '{E'
square_e: (value (',' value)* ','?)?
square_t: key | '[T'
curly_e: (key '=' value (',' key '=' value)* ','?)?
"""
