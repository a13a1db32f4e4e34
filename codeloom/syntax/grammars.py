"""Grammars of the supported languages and the test of a text against its dialects.

Rules are EBNF (see ``gll``). Operators are listed by level only where the levels change what is
accepted: an assignment needs a target, comparisons do not chain, a sign does not stand before a
power. Lines that begin with ``ts:`` or ``jsx:`` belong to dialects with types or elements.
"""

from __future__ import annotations

import re
from functools import lru_cache

from codeloom.syntax.gll import Grammar, Tokens
from codeloom.syntax.lexers import go_lexer, js_lexer, python_lexer, rust_lexer

#: Language by the last extension of a path (fixed values).
EXTENSIONS = {
    "rs": "rust",
    "ts": "type_script", "mts": "type_script", "cts": "type_script",
    "tsx": "tsx",
    "js": "java_script", "mjs": "java_script", "cjs": "java_script", "jsx": "java_script",
    "py": "python", "pyi": "python",
    "go": "go",
}

#: Parameters in order: without a default, with one, after a star; a slash at most once.
_PARAMS = """
{x}A : NAME {a} (',' {x}B?)? | NAME {a} '=' Expr (',' {x}D?)? | {x}Star ;
{x}B : NAME {a} (',' {x}B?)? | NAME {a} '=' Expr (',' {x}D?)? | '/' (',' {x}C?)? | {x}Star ;
{x}C : NAME {a} (',' {x}C?)? | NAME {a} '=' Expr (',' {x}E?)? | {x}Star ;
{x}D : NAME {a} '=' Expr (',' {x}D?)? | '/' (',' {x}E?)? | {x}Star ;
{x}E : NAME {a} '=' Expr (',' {x}E?)? | {x}Star ;
{x}Star : '*' NAME {s} (',' {x}K?)? | '*' ',' {x}N | '**' NAME {a} ','? ;
{x}K : NAME {a} ('=' Expr)? (',' {x}K?)? | '**' NAME {a} ','? ;
{x}N : NAME {a} ('=' Expr)? (',' {x}K?)? ;
"""

PYTHON = (
    """
File :: Stmt* ;
Inside :: (Yield | Values) NEWLINE ;
Stmt :: Simple | Compound ;
Simple : Small %% ';' NEWLINE ;
SimpleLine :: Simple ;
Small : Values | (Targets '=')+ (Values | Yield) | OneTarget (Aug Value | ':' Expr ('=' Value)?) | Yield
  | 'return' ValuesOf? | 'raise' (Expr ('from' Expr)?)? | 'pass' | 'break' | 'continue' | 'del' Target %% ','
  | 'assert' Expr (',' Expr)? | 'global' NAME % ',' | 'nonlocal' NAME % ',' | 'import' (Dotted ('as' NAME)?) % ','
  | 'from' ( ('.' | '...')* Dotted | ('.' | '...')+ ) 'import' ( '*' | Froms | '(' Froms ','? ')' )
  | 'type' NAME TypeParams? '=' Expr ;
Froms : (NAME ('as' NAME)?) % ',' ;
Dotted : NAME % '.' ;
Values : (ExprHere | '*' Bits) %% ',' ;
ValuesOf :: Values ;
Value :: Values | Yield ;
Yield :: 'yield' ('from' Expr | Values)? ;
Aug : '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
Targets : ('*'? TargetHere) %% ',' ;
Target :: TargetHere ;
TargetHere : NAME | Atom Trailer* ('.' NAME | Sub) | TargetParen | TargetList ;
TargetParen :: '(' (Target (',' (('*'? Target) %% ',')?)? | '*' Target ',' (('*'? Target) %% ',')?)? ')' ;
TargetList :: '[' (('*'? Target) %% ',')? ']' ;
OneTarget : NAME | Atom Trailer* ('.' NAME | Sub) | OneParen ;
OneParen :: '(' OneTarget ')' ;
Block :: NEWLINE INDENT Stmt+ DEDENT | SimpleLine ;
Compound : Def | Class | ('@' Named NEWLINE)+ (Def | Class) | If | While | For | Try | With | Match | 'async' (For | With) ;
Def :: 'async'? 'def' NAME TypeParams? Params ('->' ValuesOf)? ':' Block ;
TypeParams : '[' (('*' | '**')? NAME (':' Expr)? ('=' Expr)?) %% ',' ']' ;
Params :: '(' PA? ')' ;
Ann : (':' Expr)? ;
StarAnn : (':' '*'? Expr)? ;
Class :: 'class' NAME TypeParams? Args? ':' Block ;
If : 'if' Named ':' Block ('elif' Named ':' Block)* Else? ;
Else : 'else' ':' Block ;
While : 'while' Named ':' Block Else? ;
For : 'for' Targets 'in' ValuesOf ':' Block Else? ;
Try : 'try' ':' Block ( ('except' (Expr ('as' NAME | (',' Expr)+)?)? ':' Block)+ Else? Finally? | ('except' '*' Expr ('as' NAME | (',' Expr)+)? ':' Block)+ Else? Finally? | Finally ) ;
Finally : 'finally' ':' Block ;
With : 'with' ( WithItem % ',' | '(' WithItem %% ',' ')' ) ':' Block ;
WithItem : Expr ('as' '*'? Target)? ;
Match : 'match' Subject ':' NEWLINE INDENT Case+ DEDENT ;
Subject :: ('*' Bits | Named) %% ',' ;
Case :: 'case' Patterns ('if' Named)? ':' Block ;
Patterns : ('*' NAME | Pattern) %% ',' ;
Pattern :: Closed % '|' ('as' NAME)? ;
Closed : '-'? NUMBER (('+' | '-') NUMBER)? | STRING+ | 'None' | 'True' | 'False'
  | NAME ('.' NAME)* ('(' (PatternArg %% ',')? ')')?
  | '(' Patterns? ')' | '[' Patterns? ']' | '{' ((Key ':' Pattern | '**' NAME) %% ',')? '}' ;
Key :: Closed ;
PatternArg : Pattern | NAME '=' Pattern ;
Named :: NAME ':=' Expr | ExprHere ;
Expr :: ExprHere ;
ExprHere : Or ('if' OrOf 'else' Expr)? | 'lambda' LA? ':' Expr ;
OrOf :: Or ;
Or : ('not'* Comparison) % ('and' | 'or') ;
Comparison : Sum % ('<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?) ;
Sum : Factor % ('+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^') ;
Bits :: Sum ;
Factor : ('-' | '+' | '~')* 'await'? Atom Trailer* ;
Trailer : '.' NAME | Args | Sub ;
Atom : NAME | NUMBER | STRING+ | '...' | 'None' | 'True' | 'False' | Paren | List | Brace ;
Args :: '(' (AA | (NAME ':=' Expr | ExprHere) Comp)? ')' ;
AA : (NAME ':=' Expr | ExprHere) (',' AA?)? | '*' Expr (',' AA?)? | AB ;
AB : NAME '=' Expr (',' AB?)? | '*' Expr (',' AB?)? | '**' Expr (',' AC?)? ;
AC : NAME '=' Expr (',' AC?)? | '**' Expr (',' AC?)? ;
Sub :: '[' (NAME ':=' Expr | ExprHere? ':' Expr? (':' Expr?)? | ExprHere | '*' Bits) %% ',' ']' ;
Item : Named | '*' Bits ;
Paren :: '(' (Yield | Named (Comp | ',' (Item %% ',')?)? | '*' Bits ',' (Item %% ',')?)? ')' ;
List :: '[' (Named (Comp | ',' (Item %% ',')?)? | '*' Bits (',' (Item %% ',')?)?)? ']' ;
Brace :: '{' ( (NAME ':=' Expr | ExprHere) (Comp | (',' (Item %% ',')?)?) | '*' Bits (',' (Item %% ',')?)?
  | ExprHere ':' Expr (Comp | (',' (Pair %% ',')?)?) | '**' Bits (',' (Pair %% ',')?)? )? '}' ;
Pair : Expr ':' Expr | '**' Bits ;
Comp : ('async'? 'for' Targets 'in' OrOf ('if' OrOf)*)+ ;
"""
    + _PARAMS.format(x="P", a="Ann", s="StarAnn")
    + _PARAMS.format(x="L", a="", s="")
)

#: Expressions; in the head of a control statement (``N``) a name does not begin a literal.
_GO_EXPR = """
Expr{n} :: ExprHere{n} ;
Exprs{n} :: Expr{n} % ',' ;
ExprHere{n} : (('+' | '-' | '!' | '^' | '*' | '&' | '<-')* ({literal} Operand) Suffix*) % Binary ;
Basic{n} : ExprHere{n} ('++' | '--' | '<-' Expr{n})? | ExprHere{n} % ',' Assign Exprs{n} | NAME % ',' ':=' Exprs{n} ;
BasicOf{n} :: Basic{n} ;
"""

GO = (
    """
File :: 'package' NAME ';' ('import' (ImportSpec | '(' (ImportSpec %% ';')? ')') ';')* ((Decl | Func) ';')* ;
ImportSpec : (NAME | '.')? STR ;
Func :: 'func' (NAME TypeParams? | Params NAME) Signature Block? ;
Decl : ConstDecl | VarDecl | TypeDecl ;
ConstDecl :: 'const' (ConstSpec | '(' (ConstSpec %% ';')? ')') ;
VarDecl :: 'var' (VarSpec | '(' (VarSpec %% ';')? ')') ;
TypeDecl :: 'type' (TypeSpec | '(' (TypeSpec %% ';')? ')') ;
ConstSpec :: NAME % ',' (Type? '=' Exprs)? ;
VarSpec :: NAME % ',' (Type ('=' Exprs)? | '=' Exprs) ;
TypeSpec :: NAME TypeParams? '='? Type ;
TypeParams : '[' (NAME % ',' Constraint) %% ',' ']' ;
Constraint : ('~'? Type) % '|' ;
Signature :: Params (Params | Bare)? ;
Params :: '(' (Param %% ',')? ')' ;
Param : NAME ('...'? Type)? | '...' Type | TypeHere ;
Type :: TypeHere ;
TypeHere : Bare | '(' Type ')' ;
Bare : TypeName | '*' Type | LitType | ('chan' '<-'? | '<-' 'chan') Type | 'func' Signature | Interface ;
TypeName : NAME ('.' NAME)? ('[' Type %% ',' ']')? ;
LitType : '[' (Expr | '...')? ']' Type | 'map' '[' Type ']' Type | 'struct' '{' (Field %% ';')? '}' ;
Field : (NAME % ',' Type | '*'? TypeName) STR? ;
Interface :: 'interface' '{' (Elem %% ';')? '}' ;
Elem : NAME Signature | ('~'? TypeHere) ('|' '~'? Type)* ;
Block :: '{' Stmts '}' ;
Stmts : Stmt? % ';' ;
Stmt :: Decl | Basic | Block | 'go' Expr | 'defer' Expr | 'return' Exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough'
  | NAME ':' Stmt? | If | For | Switch | 'select' '{' CommCase* '}' ;
Assign : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
If :: 'if' (BasicN? ';')? ExprHereN Block ('else' (If | Block))? ;
For : 'for' ( ExprHereN? | BasicN? ';' ExprN? ';' BasicOfN? | (ExprHereN % ',' '=' | NAME % ',' ':=')? 'range' ExprN ) Block ;
Switch : 'switch' (BasicN? ';')? BasicN? '{' SwitchCase* '}' ;
SwitchCase : ('case' Exprs | 'default') ':' Stmts ;
CommCase : ('case' BasicOf | 'default') ':' Stmts ;
Binary : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '>' | '>=' ;
# A type may stand where an expression may: as an argument, in a conversion, in a type switch.
Operand : NAME | NUM | STR | '(' Expr ')' | 'func' Signature Block? | LitType Literal? | ('chan' '<-'? | '<-' 'chan') Type | Interface ;
Literal :: '{' ((Member (':' Member)?) %% ',')? '}' ;
Member : Expr | Literal ;
Index :: '[' (Expr %% ',' | Expr? ':' Expr? (':' Expr)?) ']' ;
Call :: '(' ((Expr '...'?) %% ',')? ')' ;
Suffix : '.' NAME | '.' '(' ('type' | Type) ')' | Call | Index ;
"""
    + _GO_EXPR.format(n="", literal="NAME ('.' NAME)? Index? Literal |")
    + _GO_EXPR.format(n="N", literal="")
)

#: Expressions; in the head of a control statement (``N``) a path does not begin a struct literal.
_RUST_EXPR = """
Expr{n} :: ExprHere{n} ;
ExprHere{n} : Range{n} (Assign Expr{n})? ;
Range{n} : Lazy{n} (('..' | '..=') LazyOf{n}?)? | ('..' | '..=') LazyOf{n}? ;
LazyOf{n} :: Lazy{n} ;
Lazy{n} : Compare{n} % ('&&' | '||') ;
Compare{n} : Sum{n} (Cmp Sum{n})? {let} ;
Sum{n} : Unary{n} % Binary ;
Unary{n} : Attr* ('-' | '!' | '*' | ('&' | '&&') ('raw' ('const' | 'mut') | 'mut')?)* Primary{n} ('as' Type)* ;
Primary{n} : (Operand | Blocky {struct}) Suffix* | Closure | 'return' Expr{n}? | 'break' LIFE? Expr{n}? | 'continue' LIFE? | 'yield' Expr{n}? ;
"""

RUST = (
    """
File :: InnerAttr* Item* ;
InnerAttr : '#' '!' Square ;
Attr : '#' Square ;
Square :: '[' TT* ']' ;
Round :: '(' TT* ')' ;
Curly :: '{' TT* '}' ;
TT : Round | Square | Curly | NAME | NUM | STR | CHAR | LIFE | Word | '_' | '<<=' | '>>=' | '...' | '..=' | '&&' | '||' | '->' | '=>' | '::' | '==' | '!='
  | '<=' | '>=' | '<<' | '>>' | '..' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '-' | '+' | '*' | '/' | '%' | '&' | '|' | '^' | '<' | '>'
  | '=' | '!' | ',' | ';' | '.' | ':' | '?' | '@' | '#' | '$' | '~' ;
Word : 'as' | 'async' | 'await' | 'break' | 'const' | 'continue' | 'crate' | 'dyn' | 'else' | 'enum' | 'extern' | 'false' | 'fn' | 'for' | 'if'
  | 'impl' | 'in' | 'let' | 'loop' | 'match' | 'mod' | 'move' | 'mut' | 'pub' | 'ref' | 'return' | 'self' | 'Self' | 'static' | 'struct'
  | 'super' | 'trait' | 'true' | 'type' | 'unsafe' | 'use' | 'where' | 'while' | 'macro' | 'box' | 'do' | 'final' | 'try' | 'yield' ;
Vis : 'pub' ('(' ('crate' | 'self' | 'super' | 'in' SimplePath) ')')? ;
SimplePath : '::'? PathWord % '::' ;
PathWord : NAME | 'crate' | 'self' | 'super' | 'Self' ;
Item :: Attr* (Vis? Thing | SimplePath '!' NAME? (Curly | (Round | Square) ';')) ;
Inner :: Attr* Vis? Thing ;
Thing : Fn | Struct | Enum | 'union' NAME Generics? Where? Fields | Trait | Impl | Mod
  | Use | Const | Alias
  | 'extern' 'crate' PathWord ('as' (NAME | '_'))? ';' | 'unsafe'? 'extern' STR? '{' InnerAttr* Item* '}' ;
Mod :: 'mod' NAME (';' | '{' InnerAttr* Item* '}') ;
Use :: 'use' UseTree ';' ;
Alias :: 'type' NAME Generics? (':' Bounds)? Where? ('=' Type)? Where? ';' ;
Const :: 'const' (NAME | '_') ':' Type ('=' Expr)? ';' | 'static' 'mut'? NAME ':' Type ('=' Expr)? ';' ;
UseTree :: '::'? (PathWord '::')* ( PathWord ('as' (NAME | '_'))? | '*' | '{' (UseTree %% ',')? '}' ) ;
Fn :: 'default'? 'const'? 'async'? 'unsafe'? ('extern' STR?)? 'fn' NAME Generics? FnParams ('->' Type)? Where? (Block | ';') ;
FnParams : '(' ((Attr* ( ('&' LIFE?)? 'mut'? 'self' (':' Type)? | Pattern ':' Type | '...' )) %% ',')? ')' ;
Generics :: '<' (Generic %% ',')? ('>' | '>1') ;
Generic : Attr* ( LIFE (':' (LIFE % '+')?)? | NAME (':' Bounds?)? ('=' Type)? | 'const' NAME ':' Type ('=' GenericArg)? ) ;
Bounds : Bound %% '+' ;
Bound : LIFE | '?'? ForLife? TypePath | '(' '?'? ForLife? TypePath ')' ;
ForLife : 'for' Generics ;
Where : 'where' ((LIFE ':' (LIFE % '+')? | ForLife? Type ':' Bounds?) %% ',')? ;
Struct :: 'struct' NAME Generics? ( Where? (Fields | ';') | Tuple Where? ';' ) ;
Fields : '{' ((Attr* Vis? NAME ':' Type) %% ',')? '}' ;
Tuple : '(' ((Attr* Vis? Type) %% ',')? ')' ;
Enum :: 'enum' NAME Generics? Where? '{' ((Attr* Vis? NAME (Fields | Tuple)? ('=' Expr)?) %% ',')? '}' ;
Trait :: 'unsafe'? 'auto'? 'trait' NAME Generics? (':' Bounds?)? Where? '{' InnerAttr* Item* '}' ;
Impl :: 'default'? 'unsafe'? 'impl' Generics? 'const'? ('!'? Type 'for')? Type Where? '{' InnerAttr* Item* '}' ;
Type :: TypeHere ;
TypeHere : TypePath | ('&' | '&&') LIFE? 'mut'? Type | '*' ('const' | 'mut') Type | '[' Type (';' Expr)? ']'
  | '(' (Type %% ',')? ')' | '!' | '_' | ('impl' | 'dyn') Bounds | ForLife? FnType | ForLife TypePath | SimplePath '!' (Round | Square | Curly) ;
FnType : 'unsafe'? ('extern' STR?)? 'fn' '(' ((((NAME | '_') ':')? Type) %% ',')? ')' ('->' Type)? ;
TypePath : (Qualified '::' | '::')? TypeSeg % '::' ;
TypeSeg : PathWord ('::'? GenericArgs | '(' (Type %% ',')? ')' ('->' Type)?)? ;
Qualified :: '<' Type ('as' TypeOf)? ('>' | '>1') ;
TypeOf :: TypePath ;
GenericArgs :: ('<' | '<1') (GenericItem %% ',')? ('>' | '>1') ;
GenericItem : LIFE | GenericArg | NAME GenericArgs? ('=' Type | ':' Bounds) ;
GenericArg : TypeHere | Block | '-'? (NUM | CHAR | STR) | 'true' | 'false' ;
Pattern :: '|'? One % '|' ;
OneOf :: One ;
One : Lit (('..=' | '...' | '..') (Lit | ExprPath)?)? | ('..=' | '..') (Lit | ExprPath)? | '_' | 'ref'? 'mut'? NAME ('@' OneOf)?
  | ExprPath ( ('..=' | '...' | '..') (Lit | ExprPath)? | '(' (Pattern %% ',')? ')' | '{' (PatField %% ',')? '}' )?
  | ('&' | '&&') 'mut'? OneOf | '(' (Pattern %% ',')? ')' | '[' (Pattern %% ',')? ']' | 'box' OneOf | 'const' Block | SimplePath '!' (Round | Square | Curly) ;
PatField : Attr* ( (NAME | NUM) ':' Pattern | 'ref'? 'mut'? NAME | '..' ) ;
Lit : '-'? NUM | STR | CHAR | 'true' | 'false' ;
ExprPath : (Qualified '::' | '::')? (PathWord ('::' GenericArgs)?) % '::' ;
# A statement that is a block goes on only as the receiver of a call, a field or a question mark.
Block :: '{' InnerAttr* (';' | Inner | 'macro_rules' '!' NAME (Curly | (Round | Square) ';') | Attr* 'let' Pattern (':' Type)? ('=' Expr ('else' Block)?)? ';'
  | Attr* (Blocky | SimplePath '!' Curly) | StmtExpr ';')* StmtExpr? '}' ;
StmtExpr : StmtRange (Assign Expr)? ;
StmtRange : StmtLazy (('..' | '..=') LazyOf?)? | ('..' | '..=') LazyOf? ;
StmtLazy : StmtCompare (('&&' | '||') LazyOf)? ;
StmtCompare : StmtSum (Cmp SumOf)? ;
SumOf :: Sum ;
StmtSum : StmtFirst (Binary SumOf)? ;
StmtFirst : Attr* ( ('-' | '!' | '*' | ('&' | '&&') ('raw' ('const' | 'mut') | 'mut')?)+ Primary | (Operand | ExprPath StructBody | Blocky Dotted) Suffix*
  | Closure | 'return' Expr? | 'break' LIFE? Expr? | 'continue' LIFE? | 'yield' Expr? ) ('as' Type)* ;
Blocky :: (LIFE ':')? ( 'unsafe'? Block | 'loop' Block | 'while' ExprN Block | 'for' Pattern 'in' ExprN Block ) | 'const' Block | 'async' 'move'? Block
  | If | 'match' ExprN '{' InnerAttr* Arms? '}' ;
If :: 'if' ExprN Block ('else' (If | Block))? ;
Arms :: (Attr* Pattern ('if' ('let' Pattern '=' Expr | Expr))? '=>' (Blocky ','? | Expr ','))* (Attr* Pattern ('if' ('let' Pattern '=' Expr | Expr))? '=>' Expr)? ;
Binary : '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' ;
Cmp : '==' | '!=' | '<' | '<=' | '>' | '>=' ;
Assign : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' ;
Closure : 'static'? 'async'? 'move'? ('|' ((Attr* OneOf (':' Type)?) %% ',')? '|' | '||') ('->' Type Block | Expr) ;
Operand : NUM | STR | CHAR | 'true' | 'false' | ExprPath | '(' (Expr %% ',')? ')' | '[' (Expr (';' Expr | (',' Expr)* ','?))? ']' | SimplePath '!' (Round | Square | Curly) | '_' ;
StructBody :: '{' (FieldInit % ',' (',' ('..' Expr?)?)? | '..' Expr?)? '}' ;
FieldInit : Attr* (NAME (':' Expr)? | NUM ':' Expr) ;
Dotted : '?' | '.' ('await' | NAME ('::' GenericArgs)? | NUM) ;
Suffix : Dotted | Call | '[' Expr ']' ;
Call :: '(' (Expr %% ',')? ')' ;
"""
    + _RUST_EXPR.format(n="", struct="| ExprPath StructBody", let="")
    + _RUST_EXPR.format(n="N", struct="", let="| 'let' Pattern '=' SumN (Cmp SumN)?")
)

JS = """
Script :: Stmt* ;
Module :: (Stmt | Import | Export)* ;
Semi : ';' | ASI ;
Import :: 'import' STR With? Semi | 'import' ImportClause 'from' STR With? Semi
ts:  | 'import' 'type' ImportClause 'from' STR With? Semi | 'import' 'type'? NAME '=' ('require' '(' STR ')' | Dotted) Semi
  ;
With : 'with' Object ;
ImportClause : NAME (',' ('*' 'as' NAME | ImportNames))? | '*' 'as' NAME | ImportNames ;
ImportNames : '{' (ImportName %% ',')? '}' ;
ImportName : NAME | (IDNAME | STR) 'as' NAME
ts:  | 'type' (NAME | IDNAME 'as' NAME)
  ;
Export : 'export' ('*' ('as' (IDNAME | STR))? 'from' STR With? Semi | ExportNames ('from' STR With?)? Semi | Decl | VarStmt
  | 'default' (FunctionDecl | Function-['async'] | 'async' FunctionOf | Decorator* Class | ExprStart Semi)
ts:  | 'type' ExportNames ('from' STR With?)? Semi | 'type' '*' ('as' IDNAME)? 'from' STR Semi | '=' Expr Semi | 'as' 'namespace' NAME Semi
ts:  | 'import' NAME '=' ('require' '(' STR ')' | Dotted) Semi | 'default' (Interface | 'abstract' Class)
  ) ;
ExportNames : '{' (ExportName %% ',')? '}' ;
ExportName : (IDNAME | STR) ('as' (IDNAME | STR))?
ts:  | 'type' IDNAME ('as' IDNAME)?
  ;
ExprStart : Assign-['function' 'class'] ;
Decl : Decorator* ClassDecl | FunctionDecl
ts:  | Interface | TypeAlias | EnumDecl | Namespace | Declare | 'abstract' ClassDecl
  ;
ts: Interface :: 'interface' NAME TypeParams? ('extends' Type % ',')? ObjectType ;
ts: TypeAlias :: 'type' NAME TypeParams? '=' Type Semi ;
ts: EnumDecl :: 'const'? 'enum' NAME '{' ((PropName ('=' Assign)?) %% ',')? '}' ;
ts: Namespace :: ('namespace' | 'module') (Dotted | STR) '{' (Stmt | Import | Export | AmbientVar)* '}' ;
ts: Declare :: 'declare' ( Decl | AmbientVar | 'global' '{' (Stmt | Import | Export | AmbientVar)* '}' | ('module') STR Semi ) ;
ts: AmbientVar : ('var' | 'let' | 'const') (Binding TypeAnn?) % ',' Semi ;
Dotted : NAME ('.' IDNAME)* ;
Stmt :: Block | ';' | Decl | VarStmt | ExprStmt Semi | 'if' '(' Expr ')' Stmt ('else' Stmt)? | 'while' '(' Expr ')' Stmt
  | 'do' Stmt 'while' '(' Expr ')' ';'? | For | 'continue' NAME? Semi | 'break' NAME? Semi | 'return' Expr? Semi | 'throw' Expr Semi
  | 'try' Block ('catch' ('(' Binding TypeAnn? ')')? Block ('finally' Block)? | 'finally' Block) | Switch | LABEL ':' Stmt | 'debugger' Semi
  | 'with' '(' Expr ')' Stmt ;
Block :: '{' Stmt* '}' ;
Switch : 'switch' '(' Expr ')' '{' ('case' Expr ':' Stmt* | 'default' ':' Stmt*)* '}' ;
For : 'for' 'await'? '(' ( (Var | Expr)? ';' Expr? ';' Expr? | (('var' | 'let' | 'const') Binding TypeAnn? | Target | ObjectTarget | ArrayTarget) ('in' Expr | 'of' Assign) ) ')' Stmt ;
VarStmt :: Var Semi ;
Var : ('var' | 'let') VarItem % ',' | 'const' ConstItem % ',' ;
VarItem :: NAME TypeAnn? ('=' Assign)? | (ObjectPattern | ArrayPattern) TypeAnn? '=' Assign
ts:  | NAME '!' TypeAnn
  ;
ConstItem :: Binding TypeAnn? '=' Assign
ts:  | NAME TypeAnn
  ;
TypeAnn :
ts:  ':' Type |
  NEVER ;
Binding : NAME | ObjectPattern | ArrayPattern
ts:  | 'this'
  ;
ObjectPattern :: '{' (PatternProp %% ',')? '}' ;
PatternProp : '...' Binding | PropName ':' Binding ('=' Assign)? | NAME ('=' Assign)? ;
ArrayPattern :: '[' ('...'? Binding ('=' Assign)?)? % ',' ']' ;
# What may stand left of an equals sign besides names and members.
ObjectTarget :: '{' (('...' Target | PropName ':' AnyTarget ('=' Assign)? | NAME ('=' Assign)?) %% ',')? '}' ;
ArrayTarget :: '[' ('...'? AnyTarget ('=' Assign)?)? % ',' ']' ;
AnyTarget :: Target | ObjectTarget | ArrayTarget ;
ExprStmt : Expr-['{' 'function' 'class'] ;
Expr :: AssignHere % ',' ;
Assign :: AssignHere ;
AssignHere : Target AssignOp Assign | (ObjectTarget | ArrayTarget) '=' Assign | Cond | Arrow | 'yield' ('*'? Assign)? ;
AssignOp : '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
Target : NAME | '(' Expr ')' | Primary Suffix* Member1 ;
Member1 : '.' (IDNAME | PRIV) | '[' Expr ']'
ts:  | '!'
  ;
Cond : Logic ('?' Assign ':' Assign)? ;
Logic : Binary ((('&&' | '||') Binary)* | ('??' Binary)*) ;
Binary : Operand % BinaryOp ;
Operand : Power
ts:  ( ('as' | 'satisfies') Type | 'as' 'const' )*
  | PRIV ;
BinaryOp : '+' | '-' | '*' | '/' | '%' | '<<' | '>>' | '>>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&' | '|' | '^' | 'in' | 'instanceof' ;
# A sign does not stand before the base of a power.
Power : (Update '**')* Sign* Update ;
Sign : '+' | '-' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await'
cast:  | '<' (Type | 'const') '>'
  ;
Update : ('++' | '--') Target | 'new'* Primary Suffix* | Target ('++' | '--') ;
Suffix : '.' (IDNAME | PRIV) | '?.' (IDNAME | PRIV | '[' Expr ']' | Args | Template) | '[' Expr ']' | Args | Template
ts:  | '!' | TypeArgs | '?.' TypeArgs Args
  ;
Args :: '(' (('...'? Assign) %% ',')? ')' ;
Primary : NAME | NUM | STR | REGEX | Template | '(' Expr ')' | Array | Object | Function | Decorator* Class | 'this' | 'super' | 'null' | 'true' | 'false'
  | 'import' (Args | '.' IDNAME) | 'new' '.' 'target'
jsx:  | Element
  ;
Template :: TFULL | THEAD Expr (TMID Expr)* TTAIL ;
Array :: '[' ('...'? Assign)? % ',' ']' ;
Object :: '{' (Prop %% ',')? '}' ;
Prop : '...' Assign | PropName ':' Assign | NAME | ('get' | 'set' | 'async'? '*'?) PropName TypeParams? Params ReturnAnn? Block ;
PropName : IDNAME | STR | NUM | '[' Assign ']' | PRIV ;
FunctionDecl :: 'async'? 'function' '*'? NAME TypeParams? Params ReturnAnn? FunctionBody ;
Function :: 'async'? 'function' '*'? NAME? TypeParams? Params ReturnAnn? Block ;
FunctionOf :: 'function' '*'? TypeParams? Params ReturnAnn? Block ;
FunctionBody : Block
ts:  | Semi
  ;
ReturnAnn :
ts:  ':' ReturnType |
  NEVER ;
Params :: '(' (Param %% ',')? ')' ;
Param : Decorator*
ts:  ('public' | 'private' | 'protected' | 'readonly' | 'override')*
  '...'? Binding
ts:  '?'?
  TypeAnn? ('=' Assign)? ;
Arrow : 'async'? (NAME | TypeParams? Params ReturnAnn?) '=>' (Block | Assign-['{']) ;
Decorator : '@' DecoratorOf ;
DecoratorOf :: Primary Suffix* ;
ClassDecl :: 'class' NAME ClassRest ;
Class :: 'class' NAME? ClassRest ;
ClassRest : TypeParams? ('extends' Heritage)?
ts:  ('implements' Type % ',')?
  '{' (';' | 'static' Block | Member)* '}' ;
Heritage :: 'new'* Primary Suffix* ;
Member :: Decorator* Modifier* ( Field Semi | Method ) ;
Modifier : 'static' | 'async' | 'get' | 'set' | '*' | 'accessor'
ts:  | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'declare' | 'override'
  ;
Field : PropName
ts:  ('?' | '!')?
  TypeAnn? ('=' Assign)?
ts:  | '[' NAME ':' Type ']' TypeAnn
  ;
Method : PropName
ts:  '?'?
  TypeParams? Params ReturnAnn? (MethodBody
ts:  | Semi
  ) ;
MethodBody :: Block ;
TypeParams :
ts:  TypeParamsOf |
  NEVER ;
ts: TypeParamsOf :: '<' (('const' | 'in' | 'out')* NAME ('extends' Type)? ('=' Type)?) %% ',' '>' ;
ts: ReturnType :: TypeHere | 'asserts' (NAME | 'this') ('is' Type)? | (NAME | 'this') 'is' Type ;
ts: Type :: TypeHere ;
ts: TypeHere : FnType | Union ('extends' Type '?' Type ':' Type)? ;
ts: FnType : 'abstract'? 'new'? TypeParams? Params '=>' ReturnType ;
ts: Union : '|'? Intersection % '|' ;
ts: Intersection : '&'? TypeUnary % '&' ;
ts: TypeUnary : ('keyof' | 'unique' | 'readonly')* TypePrimary ('[' Type? ']')* | 'infer' NAME ('extends' TypePostfix)? ;
ts: TypePostfix :: TypePrimary ('[' Type? ']')* ;
ts: TypePrimary : Dotted TypeArgs? | STR | '-'? NUM | TFULL | THEAD Type (TMID Type)* TTAIL | 'null' | 'void' | 'true' | 'false' | 'this' | ObjectType | '[' (TupleItem %% ',')? ']'
ts:  | '(' Type ')' | 'typeof' (Dotted TypeArgs? | 'import' '(' STR ')' ('.' IDNAME)* | 'this' ('.' IDNAME)*) | 'import' '(' STR ')' ('.' IDNAME)* TypeArgs? ;
ts: TupleItem : '...'? (IDNAME '?'? ':')? Type '?'? ;
ts: TypeArgs :: '<' Type % ',' '>' ;
ts: ObjectType :: '{' (TypeMember (';' | ',' | ASI))* TypeMember? '}' ;
ts: TypeMember : ('readonly' | '-' 'readonly' | '+' 'readonly' | 'get' | 'set')? ( PropName '?'? ( TypeAnn? | TypeParams? Params ReturnAnn? ) | '[' NAME ':' Type ']' TypeAnn
ts:  | '[' NAME 'in' Type ('as' Type)? ']' (('-' | '+')? '?')? TypeAnn? ) | 'new'? TypeParams? Params ReturnAnn? ;
# Before text between elements nothing is passed over: there GT and RB stand for the closing marks.
jsx: Element :: '<' ( GT Child* '<' '/' '>' | TagName Attribute* ('/' '>' | GT Child* '<' '/' TagName '>') ) ;
jsx: Inner :: '<' ( GT Child* '<' '/' GT | TagName Attribute* ('/' GT | GT Child* '<' '/' TagName GT) ) ;
jsx: TagName : (IDNAME | JSXID) (('.' | ':') IDNAME)*
jsxts:  TypeArgs?
jsx:  ;
jsx: Attribute : (IDNAME | JSXID) (':' IDNAME)? ('=' (STR | '{' Assign '}' | Element))? | '{' '...' Assign '}' ;
jsx: Child : JSXTEXT | Inner | '{' ('...'? Expr)? RB ;
"""


def _only(text: str, *features: str) -> str:
    """The rules of ``text`` for a dialect with ``features``."""
    out = []
    for line in text.splitlines():
        m = re.match(r"(ts|jsx|jsxts|cast):(?!:)", line)
        if m is None or m[1] in features:
            out.append(line[m.end() :] if m else line)
    return "\n".join(out)


@lru_cache(maxsize=None)
def grammar(dialect: str) -> Grammar:
    """The compiled grammar of a dialect, built once per process."""
    text = {
        "python": PYTHON,
        "go": GO,
        "rust": RUST,
        "js": _only(JS),
        "jsx": _only(JS, "jsx"),
        "ts": _only(JS, "ts", "cast"),
        "tsx": _only(JS, "ts", "jsx", "jsxts"),
    }[dialect]
    return Grammar(text)


#: Start symbols of a dialect that run together: a text is valid if one of them accepts it.
STARTS = {"python": ("File",), "go": ("File",), "rust": ("File",), "js": ("Script", "Module"), "jsx": ("Script", "Module"), "ts": ("Script", "Module"), "tsx": ("Script", "Module")}


def dialects_of(path: str) -> tuple[str, ...]:
    """The dialects of a path's extension; empty where it is no source file."""
    ext = path.rsplit("/", 1)[-1].rpartition(".")
    language = EXTENSIONS.get(ext[2]) if ext[1] else None
    if language is None:
        return ()
    if language == "java_script":
        return ("jsx",) if ext[2] == "jsx" else ("js",)
    return {"type_script": ("ts",), "tsx": ("tsx",)}.get(language, (language,))


@lru_cache(maxsize=1 << 16)
def _is_expression(text: str) -> bool:
    """Whether a text can stand in a replacement field of an f-string."""
    inner: list[str] = []
    return bool(text.strip()) and grammar("python").accepts(python_lexer("(" + text + ")", inner), ("Inside",)) and all(map(_is_expression, inner))


def tokens_of(dialect: str, text: str, exprs: list[str]) -> Tokens:
    """The tokens of a text; ``exprs`` receives nested expressions."""
    if dialect == "python":
        return python_lexer(text, exprs)
    if dialect == "go":
        return go_lexer(text)
    return rust_lexer(text) if dialect == "rust" else js_lexer(text, dialect in ("jsx", "tsx"))


def is_blank(text: str) -> bool:
    return not text.strip("\ufeff \t\r\n\f")


def is_valid(path: str, text: str) -> bool:
    """Whether a dialect of the path's language accepts the text; a blank file is valid
    (Go's grammar needs a package clause, but a blank Go file counts as valid too)."""
    if is_blank(text):
        return True
    for d in dialects_of(path):
        exprs: list[str] = []
        if grammar(d).accepts(tokens_of(d, text, exprs), STARTS[d]) and all(map(_is_expression, exprs)):
            return True
    return False
